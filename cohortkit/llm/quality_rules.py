"""Host-level quality rules, in DataFrame operations only.

Each document gets text statistics and rule failures.  Failures are
aggregated per host (the ``source`` column), a host's failure rate per rule is
shrunk towards the corpus by a beta prior fitted to the hosts' own rates, and
a host whose shrunk rate exceeds the limit is rejected with all its documents.

Edge cases: null and empty texts have no words (they fail ``few_words``); null
hosts are one host; repeated rows count once each; with one host, or hosts
that do not differ, the prior falls back to a weight of ``PRIOR_WEIGHT``
documents at the corpus rate; very long texts are judged whole; further columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import cut, group_key, join_by_key, words

WINDOW = 5            # words per window in the repetition rule
MIN_WORDS = 10
REPEAT_PERCENT = 20   # share of words inside repeated windows
SYMBOL_PERCENT = 10   # symbols against word characters
DUP_LINES = 3         # repeated lines
HOST_LIMIT = 0.5      # shrunk failure rate above which a host is rejected
PRIOR_WEIGHT = 20.0   # prior documents where the hosts give no estimate
SYMBOLS = "#*$%&|<>"


def repeated_window_words(w: Column, k: int = WINDOW) -> Column:
    """Words inside k-word windows that occur twice or more, the first included.

    Windows are compared by 64-bit hashes.  Hashes with their positions are
    sorted; a window is repeated when a neighbour in that order is equal, and
    the union of the windows' intervals is counted in position order.
    """
    n = F.size(w) - k + 1
    at = F.sequence(F.lit(1), n)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(k)]))

    def bind(value, body):  # a lambda variable: evaluated once, not at every use
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def union_size(starts):
        zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda s, i: F.struct(
            (s["total"] + i + k - F.greatest(s["end"], i)).alias("total"), (i + k).alias("end")), lambda s: s["total"])

    def count(order):
        def repeated(x, j):
            return (F.get(order, j - 1)["h"] == x["h"]) | (F.get(order, j + 1)["h"] == x["h"])

        return union_size(F.sort_array(F.transform(
            F.filter(order, lambda x, j: F.coalesce(repeated(x, j), F.lit(False))), lambda x: x["i"])))

    def sort(hs):
        return F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    # most texts repeat no window: a hash set tells before anything is sorted
    found = bind(hashes, lambda hs: F.when(
        F.size(F.array_distinct(hs)) < F.size(hs), bind(sort(hs), count)).otherwise(F.lit(0)))
    return F.when(n > 1, found).otherwise(F.lit(0)).cast("long")


def text_stats(docs: DataFrame, keep=("doc_id", "source")) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, text.alias("_text"), words(F.col("text")).alias("_w"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", rf"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("_w")).alias("n_repeat_words"))


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def rules() -> dict[str, Column]:
    """The rules aggregated per host; each is true where a document fails."""
    return {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repetition": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "dup_lines": F.col("n_dup_lines") >= DUP_LINES,
    }


def host_verdicts(stats: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: _key, documents, shrunk rate per rule, ``host_kept``.

    The beta prior of a rule has the mean of the host rates, and the weight
    (alpha + beta) that matches their variance beyond binomial noise is
    m (1 - m) / variance - 1.
    """
    names = list(rules())
    per = stats.groupBy(group_key(F.col("source")).alias("_key")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        *[F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))).alias(f"_f_{r}") for r, c in rules().items()])
    per = per.transform(cut)  # one row per host, read twice
    moments = per.agg(*[x for r in names for x in (
        F.avg(F.col(f"_f_{r}") / F.col("host_docs")).alias(f"_m_{r}"),
        F.var_samp(F.col(f"_f_{r}") / F.col("host_docs")).alias(f"_v_{r}"))])
    out = per.crossJoin(F.broadcast(moments))  # one row
    for r in names:
        m, v = F.col(f"_m_{r}"), F.col(f"_v_{r}")
        weight = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(1.0))).otherwise(F.lit(PRIOR_WEIGHT))
        out = out.withColumn(f"rate_{r}", (F.col(f"_f_{r}") + m * weight) / (F.col("host_docs") + weight))
    worst = F.greatest(*[F.col(f"rate_{r}") for r in names])
    return out.select("_key", "host_docs", *[f"rate_{r}" for r in names], (worst <= limit).alias("host_kept"))


def host_rules(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per document: statistics, base_failed, host rates, host_kept and kept.

    Texts are read once; the statistics (a few numbers per document) go to
    the checkpoint folder, are aggregated per host with a map-side combine,
    and the host table is broadcast if small (counted), else joined salted.
    """
    stats = text_stats(docs).transform(cut)
    verdicts = host_verdicts(stats, limit).transform(cut)
    rows = stats.withColumn("base_failed", base_failed()).withColumn("_key", group_key(F.col("source")))
    return (join_by_key(rows, verdicts, "_key").drop("_key")
            .withColumn("kept", ~F.col("base_failed") & F.col("host_kept")))
