"""Mix sources to target weights (repetition rates with hash-seeded coins).

Word totals are aggregated per source, target sizes come from the weights by
water-filling on that one-row-per-source table, and a document is emitted
``floor(rate)`` times plus once more when its seeded coin falls below the
fraction of the rate.

Edge cases: null and empty texts have size 0; null sources are one source,
ordered last; a source of size 0 has target 0 and rate 0; repeated rows with
one ``doc_id`` share a coin; rows without ``doc_id`` take the coin of their
text; very long texts are counted whole; input columns keep their names and
values, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import cut, group_key, join_by_key, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5   # the mix holds this many times the words of all sources
CAP = 2       # no source above this many times its own size
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, size) rows -> one row per source: key, source_size, target, rate.

    Sources in code point order (null last) take ``weights`` in turn.  With
    level L the target of a source is min(cap * size, L * weight); L is where
    the targets add up to ``share`` times all sizes.  Sources sorted by
    cap / weight fill up in that order, so L follows from prefix sums over
    the per-source table (a window over one row per source).
    """
    per = (sizes.groupBy(group_key(F.col("source")).alias("_key"))
           .agg(F.min("source").alias("_name"), F.sum("size").cast("long").alias("source_size")))
    order = Window.orderBy(F.col("_name").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    per = per.withColumn("_ratio", F.lit(float(cap)) * F.col("source_size") / F.col("_w"))
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("_name").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    room = (F.lit(float(share)) * F.sum("source_size").over(every)
            - F.coalesce(F.lit(float(cap)) * F.sum("source_size").over(before), F.lit(0.0)))
    rest = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    per = per.withColumn("_level", room / rest)
    level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(every)
    capped = F.lit(float(cap)) * F.col("source_size")
    target = F.least(capped, F.coalesce(level * F.col("_w"), capped))
    return (per.withColumn("target", target)
            .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                        .otherwise(F.lit(0.0)))
            .select("_key", "source_size", "target", "rate"))


def coin(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the seed and the document."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies.

    The texts are read once; sizes and coins are kept in the checkpoint
    folder.  The source table is broadcast when it is small (counted),
    otherwise joined with salted keys.
    """
    sized = docs.select(
        F.col("doc_id"), F.col("source"), F.size(words(F.col("text"))).cast("long").alias("size"),
        coin(F.col("doc_id"), F.col("text"), seed).alias("_coin")).transform(cut)
    targets = source_targets(sized, weights, share, cap).transform(cut)
    rows = sized.withColumn("_key", group_key(F.col("source")))
    return (join_by_key(rows, targets, "_key")
            .withColumn("copies", copies(F.col("rate"), F.col("_coin")))
            .select("doc_id", "size", "source_size", "target", "copies"))


def copies(rate: Column, toss: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(toss < rate - whole, F.lit(1)).otherwise(F.lit(0))).cast("long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every column of ``docs``, each document as often as its copies."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),  # kept apart from the columns below
                       group_key(F.col("source")).alias("_key"), coin(F.col("doc_id"), F.col("text"), seed).alias("_coin"))
    sizes = docs.select("source", F.size(words(F.col("text"))).alias("size"))
    targets = source_targets(sizes, weights, share, cap).select("_key", "rate").transform(cut)
    n = copies(F.col("rate"), F.col("_coin")).cast("int")
    return (join_by_key(rows, targets, "_key", spread=["_coin"])
            .select("doc", F.explode(F.array_repeat(F.lit(1), n))).select("doc.*"))
