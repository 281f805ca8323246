"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a file is named by the SHA-256 of its content.  The ledger
holds one row per (blob, rule, rule version) that was ever scanned, with the
spans found.  A run scans only pairs that the ledger lacks, each distinct
blob once however many paths share it, and joins the findings of the current
rule versions back to all paths.

Edge cases: a null text is the empty blob; empty texts have no spans; equal
texts share one blob; rows with equal or null ids keep a row each; very long
texts are scanned whole; other columns are handed on, but those named ``_blob``
and ``_spans`` are replaced; an empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import BROADCAST_ROWS, cut


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts when its ``group`` has ``least`` characters."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

# A PEM private key goes from its BEGIN line to the END line of the same label, if that is the next BEGIN or END;
# else over the key headers and base64 lines that follow (indented, quoted or with escaped line ends).  Groups
# are repeated possessively, which Java matches in a loop, so long texts need no deep stack.
_BASE64 = r"[A-Za-z0-9+/]"
_BREAK = r"""(?:[\x20\t"',;+]*+(?:\r\n?|\n|\\[rn]))"""
_LINE_END = r"""(?=[\x20\t"',;+]*+(?:[\r\n]|\\[rn]|$))"""
_KEY_LINE = (rf"""{_BREAK}*+[\x20\t>#*"']*+(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):\x20[^\r\n\\]*+"""
             rf"|{_BASE64}{{32,}}+={{0,2}}|{_BASE64}{{16,}}+={{0,2}}{_LINE_END})")
_LAST_LINE = rf"""{_BREAK}[\x20\t>#*"']*+{_BASE64}{{1,15}}+={{0,2}}{_LINE_END}"""
_PEM = (r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY((?: BLOCK)?)-----"
        r"(?:(?>[\s\S]*?(?=-----(?:BEGIN|END) ))-----END \1PRIVATE KEY\2-----"
        rf"|(?:(?:{_KEY_LINE})++(?:{_LAST_LINE})?+)?+)")

# The first three rules and their order.
RULES = (
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    # runs of one class: asking for 32 at once finds the same runs as filtering afterwards
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", 2, _PEM, 0, 1),
)
BASE_KINDS = ("assign", "access", "hex")

SPAN = "struct<start:bigint,end:bigint>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of a rule as code point spans (end exclusive).

    The text is split at the matches; the lengths of the pieces and matches
    add up to the offsets.
    """
    pat = F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, pat, F.lit(0))
    keys = F.regexp_extract_all(text, pat, F.lit(rule.group))
    parts = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("p"), hits.alias("h"), keys.alias("k"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(state, part):
        start = state["pos"] + F.length(part["p"])
        end = start + F.length(part["h"])
        span = F.struct(start.alias("start"), end.alias("end"))
        found = F.when(F.length(part["k"]) >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("pos"), found.alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), none.alias("spans"))
    return F.when(text.rlike(rule.pattern), F.aggregate(parts, start, step, lambda s: s["spans"])).otherwise(none)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Ledger rows (blob, kind, version, spans) of the pairs that ``ledger`` lacks.

    ``versions`` needs a column ``text``; its other columns are not read.
    Blobs are made distinct with a map-side combine, so a blob that a third
    of all rows share travels once per task.
    """
    blobs = (versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("_text"))
             .groupBy("blob").agg(F.first("_text").alias("_text")))
    if ledger is not None:
        seen = (ledger.groupBy("blob")
                .agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("_seen")))  # bounded by the rule versions
        blobs = blobs.join(seen, "blob", "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<string>")))
        names = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
        blobs = blobs.where(F.size(F.array_except(names, F.col("_seen"))) > 0)
    scans = []
    for r in rules:
        spans = rule_spans(F.col("_text"), r)
        if ledger is not None:
            spans = F.when(~F.array_contains("_seen", f"{r.kind}@{r.version}"), spans)
        scans.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans.alias("spans")))
    return (blobs.select("blob", F.explode(F.array(*scans)).alias("_s"))
            .select("blob", "_s.kind", "_s.version", "_s.spans")
            .where(F.col("spans").isNotNull()))


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans) of blobs with findings under the current rule versions.

    ``spans`` are structs (start, rank, kind, end) by start, then rule order.
    """
    current = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}@{r.version}"), F.lit(i))])
    tagged = (ledger.where(F.size("spans") > 0)
              .withColumn("_rank", F.try_element_at(current, F.concat_ws("@", "kind", "version")))
              .where(F.col("_rank").isNotNull()))
    one = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("_rank").alias("rank"),
                                                  F.col("kind").alias("kind"), s["end"].alias("end")))
    return (tagged.groupBy("blob")  # at most one row per rule in a group
            .agg(F.sort_array(F.flatten(F.collect_list(one))).alias("spans")))


def scan_paths(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Every row of ``versions`` with ``_blob`` and ``_spans`` (null: no findings); input columns of these names are replaced.

    Blobs with findings are few: up to ``BROADCAST_ROWS`` of them (counted) are
    broadcast, so a blob that a third of all rows share stays where its rows are.
    Beyond that the written table is joined by an exchange that adaptive
    execution can split.
    """
    versions = versions.drop("_blob", "_spans")
    new = scan_new(versions, ledger, rules)
    every = new if ledger is None else new.unionByName(ledger.select("blob", "kind", "version", "spans"))
    found = findings(every, rules).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    found = found.transform(cut)
    few = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return versions.withColumn("_blob", blob_id(F.col("text"))).join(few, "_blob", "left")


def digest_columns(spans: Column, kinds=BASE_KINDS) -> dict[str, Column]:
    """Counts per kind, the SHA-256 of the base spans, and all spans as text."""
    spans = F.coalesce(spans, F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))

    def text(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    cols = {f"n_{k}": count(k) for k in kinds}
    cols["base_sha256"] = F.sha2(text(F.filter(spans, lambda s: s["kind"].isin(*kinds))), 256)
    cols["spans"] = text(spans)
    return cols


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span (overlaps merged) replaced by ``[kind]``."""
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substring(text, (state["pos"] + 1).cast("int"), (s["start"] - state["pos"]).cast("int"))
        fresh = F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(state["pos"], s["end"]).alias("pos"),
                        F.when(s["start"] >= state["pos"], fresh).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    rest = F.substring(text, (done["pos"] + 1).cast("int"), F.lit(2 ** 31 - 1))
    return F.when(F.size(spans) > 0, F.concat(done["out"], rest)).otherwise(text)
