"""N-gram Jaccard join with token-combination prefixes.

The tokens of a text are its word shingles.  Tokens are put in one global
order, rare before frequent.  Two sets with Jaccard similarity t share at
least a = ceil(t |x|) tokens of x, so

* their first common token lies in the first |x| - a + 1 tokens of x, and
* their first k common tokens lie in the first |x| - a + k (the prefix
  extended by k - 1).

Tokens in few texts are indexed alone.  Frequent ones are dealt by their hash
into groups of about three tokens of a prefix, and each group is indexed by its
combinations of k tokens, k by the class of their document frequency.  Two
texts that share no k-combination of a group differ in all of the group's
prefix tokens but k - 1.  So a prefix is extended until the tokens in it, less
k - 1 for every group, exceed what x may miss, |x| - a: then x and y must share
a single token or a combination.  Both follow one rule for the groups, given by
the size band of the smaller text: a text is indexed under its own band and
the one below, and the band is part of the entry.  A text has some multiple of
its prefix length of entries, whatever its length and its tokens' frequencies.

Sets that share an index entry are verified exactly on their whole shingle
sets.  Tokens that one distinct text alone holds are never indexed, so texts
without near copies leave at this point.

Document frequencies are counted over all distinct texts: parts of the corpus
exchange compact hash blobs with hash-range buckets (see ``blobs``) and learn
the frequency class (power of two) of each of their tokens.

Exact copies (equal shingle sets) are one node of the join.  Entries of one
text are dropped by their hash alone, and of the many entries that near copies
share, one of each set of members is kept (told apart by 128 bits over the
members).  An entry first links all members to its most central member; only
members that stay in another component are compared with the rest, size band
by size band, and only where sizes and the number of shared tokens still allow
a link.  Components come from star steps over the verified links; they are
joined to the texts, one row each, not to their entries.

Edge cases: null texts and texts without words have the empty set and link
with nothing, copies of them included; texts with fewer words than a shingle
are one shingle; rows that share a ``doc_id`` are judged by their texts; rows
without ``doc_id`` link, but name no component (null if no linked row has an
id); very long texts are taken whole; further columns are ignored, whatever
their names (``one_of_each`` hands them on); an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm import blobs as B
from cohortkit.llm import kernels as K
from cohortkit.llm.common import cut, text_bytes
from cohortkit.operators.components import connected_components

SHINGLE = 3
PERCENT = 90             # Jaccard similarity in percent
WIDER = (7, 14)          # tokens in 2**7 distinct texts are combined by two, in 2**14 by three
MOST_TASKS = 20_000      # parts of a very large corpus share shuffle partitions

_SETS = "doc_id bigint, text_hash bigint, n bigint, digest binary"
_CANDIDATES = "digest binary, n bigint, shared bigint, entries array<bigint>, tokens binary"


def shingle_sets(texts, k: int):
    """For each text of an Arrow column its sorted distinct shingle hashes."""
    data, off = K.utf8(texts)
    for i, j in K.chunks(off):
        h, woff = K.word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i], K.space_words(), K.byte_values(lower=True))
        grams = K.window_hashes(h, k)
        for d in range(j - i):
            a, b = int(woff[d]), int(woff[d + 1])
            if b - a >= k:
                yield K.distinct(grams[a:b - k + 1])
            elif b > a:  # fewer words: the whole sequence, told apart from longer shingles by its length
                yield K.mix(K.window_hashes(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def document_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, hash of its text, set size n, digest of the set (null for empty sets)."""
    def run(batches):
        for batch in batches:
            sets = [(len(s), _digest(s) if len(s) else None) for s in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([s[0] for s in sets], pa.int64()),
                 pa.array([s[1] for s in sets], pa.binary())], names=["doc_id", "text_hash", "n", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
                       ).mapInArrow(run, _SETS)


def distinct_texts(docs: DataFrame, n_parts: int, k: int = SHINGLE) -> DataFrame:
    """(part, digest, text): one text per distinct non-empty set.

    Each task drops the copies it sees itself, so a text that a third of all
    rows share is shuffled once per task; the rest is dropped after the
    exchange on the part, which later steps share.
    """
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keep, digests = [], []
            for i, tokens in enumerate(shingle_sets(batch.column("text"), k)):
                if len(tokens) and (d := _digest(tokens)) not in seen:
                    seen.add(d)
                    keep.append(i)
                    digests.append(d)
            parts = [int.from_bytes(d[:8], "little") % n_parts for d in digests]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int64()), pa.array(digests, pa.binary()), batch.column("text").take(pa.array(keep, pa.int64()))],
                names=["part", "digest", "text"])

    return (docs.select("text").mapInArrow(run, "part bigint, digest binary, text string")
            .repartition(min(n_parts, MOST_TASKS), "part").groupBy("part", "digest").agg(F.first("text").alias("text")))


def combinations_of(tokens: np.ndarray, size: int, ends: np.ndarray) -> np.ndarray:
    """Hashes of all ``size``-token combinations inside runs of tokens; ``ends``: where each token's run ends."""
    at = np.arange(len(tokens))[:, None]
    for _ in range(size - 1):  # extend each combination by every later token of its run
        later = ends[at[:, -1]] - 1 - at[:, -1]
        rows = np.repeat(np.arange(len(at)), later)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(later) - later, later)
        at = np.column_stack([at[rows], at[rows, -1] + 1 + step])
    h = np.full(len(at), size, dtype=np.uint64)
    for c in range(size):
        h = h * np.uint64(K.WORD_BASE) + tokens[at[:, c]]
    return h


def _step(percent: int) -> float:
    return math.log(100 / percent) + 1e-6


def size_band(n: int, percent: int) -> int:
    """Sizes of a linked pair differ by at most the factor 100 / percent, so by at most one band."""
    return int(math.log(n) / _step(percent))


def grouping(band: int, percent: int) -> tuple[int, int]:
    """(most tokens in a combination, groups of each width) for texts of a band and the next.

    Groups cost a text up to k - 1 tokens each; what is left must still exceed what it may miss.
    """
    smallest = max(1, int(math.exp(band * _step(percent)) * (1 - 1e-9)))
    least = -(-percent * smallest // 100)
    most, cost = len(WIDER) + 1, len(WIDER) * (len(WIDER) + 1) // 2
    if least - 1 < cost:
        return (2, 1) if least > 1 else (1, 1)
    return most, max(1, min(-(-(smallest - least + 1) // 2), (least - 1) // cost))


def index_entries(tokens: np.ndarray, classes: np.ndarray, percent: int):
    """(entries, shared tokens) of one set: rare singles and frequent combinations; no entries: no partner."""
    n = len(tokens)
    least = -(-percent * n // 100)
    shared = int((classes > 0).sum())
    if shared < least:
        return None, shared
    order = np.lexsort((tokens, classes))  # tokens that no other text holds come first and meet nothing
    tokens, classes = tokens[order], classes[order]
    width = 1 + sum((classes >= w).astype(np.int64) for w in WIDER)
    own, entries = size_band(n, percent), []
    for band in {own, max(own - 1, 0)}:
        most, groups = grouping(band, percent)
        k = np.minimum(width, most)
        group = np.where(k > 1, k * groups + (tokens % np.uint64(groups)).astype(np.int64), 0)
        by_group = np.argsort(group, kind="stable")
        first = np.searchsorted(group[by_group], group[by_group])
        rank = np.empty(n, np.int64)
        rank[by_group] = np.arange(n) - first
        left = np.cumsum((k == 1) | (rank >= k - 1))
        end = int(np.searchsorted(left, n - least + 1)) + 1  # the extended prefix
        assert left[-1] >= n - least + 1
        kinds = [(1, tokens[:end][(k[:end] == 1) & (classes[:end] > 0)])]
        inside = by_group[by_group < end]
        for size in range(2, most + 1):
            some = inside[k[inside] == size]
            ends = np.searchsorted(group[some], group[some], side="right")
            kinds.append((size, combinations_of(tokens[some], size, ends)))
        for size, hashes in kinds:
            entries.append(K.mix(hashes * np.uint64(K.WORD_BASE) + np.uint64(8 * band + size)))
    entries = K.distinct(np.concatenate(entries))
    return (entries if len(entries) else None), shared


def candidates(docs: DataFrame, k: int, percent: int, part_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """Distinct texts that may have a partner: digest, n, shared, index entries, shingle set."""
    size = text_bytes(docs)
    # a part keeps its shingle sets beside the texts, so it is half a side; buckets stand for four sides
    part_bytes, bucket_bytes = part_bytes or B.side_bytes(size) // 2, bucket_bytes or B.side_bytes(size)
    n_parts, n_buckets = max(1, -(-size // part_bytes)), max(1, -(-size // (4 * bucket_bytes)))
    # frequencies are counted per slot, a hash prefix with room for 64 slots per token
    bits = min(64, max(32, int(size).bit_length() + 6))
    texts = distinct_texts(docs, n_parts, k)

    def slots_of(tokens):
        return K.distinct(tokens >> np.uint64(64 - bits), is_sorted=True)

    def send(key, table):
        slots = [slots_of(s) for s in shingle_sets(table.column("text"), k)]
        values, counts = np.unique(np.concatenate(slots), return_counts=True)
        return B.hash_rows(key[0].as_py(), values, n_buckets, bits, np.minimum(counts, 255).astype(np.uint8))

    def answer(key, table):
        rows = sorted(zip(table.column("part").to_pylist(), table.column("n").to_pylist(), table.column("data").to_pylist()))
        values = np.concatenate([B.decode(blob, n) for _, n, blob in rows])
        values.sort()
        known = K.distinct(values, is_sorted=True)
        del values  # a bucket's hashes are held once; each part's are decoded again where they are used
        total = np.zeros(len(known), np.int64)
        for _, n, blob in rows:
            total[np.searchsorted(known, B.decode(blob, n))] += np.frombuffer(blob, np.uint8, offset=8 * n)
        classes = np.minimum(np.log2(total), 63).astype(np.uint8)
        return B.answers([part for part, _, _ in rows], key[0].as_py(),
                         [classes[np.searchsorted(known, B.decode(blob, n))].tobytes() for _, n, blob in rows])

    def finish(key, left, right):
        sets = list(shingle_sets(left.column("text"), k))
        values = K.distinct(np.concatenate([slots_of(s) for s in sets]))
        classes = np.zeros(len(values), np.uint8)
        edges = B.bucket_edges(values, n_buckets, bits)
        for b, data in zip(right.column("bucket").to_pylist(), right.column("data").to_pylist()):
            classes[edges[b]:edges[b + 1]] = np.frombuffer(data, np.uint8)
        rows = []
        for digest, tokens in zip(left.column("digest").to_pylist(), sets):
            own = classes[np.searchsorted(values, tokens >> np.uint64(64 - bits))]
            entries, shared = index_entries(tokens, own, percent)
            if entries is not None:
                rows.append((digest, len(tokens), shared, entries.view(np.int64), tokens.tobytes()))
        cols = list(zip(*rows)) or [[]] * 5
        types = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                    names=["digest", "n", "shared", "entries", "tokens"])

    sent = texts.groupBy("part").applyInArrow(send, B.HASH_SCHEMA)
    said = sent.groupBy("bucket").applyInArrow(answer, B.ANSWER_SCHEMA)
    return texts.groupBy("part").cogroup(said.groupBy("part")).applyInArrow(finish, _CANDIDATES)


def _may_link(percent: int):
    """Whether the texts a and b, both compared with their entry's centre c, may still link.

    They share at most what c shares with either, and outside c no more than
    the tokens that either has in common with any other text.  A link needs an
    overlap of t / (1 + t) (n_a + n_b).
    """
    most = F.least("both_a", "both_b") + F.least(F.col("shared_a") - F.col("both_a"), F.col("shared_b") - F.col("both_b"))
    return F.lit(100 + percent) * most >= F.lit(percent) * (F.col("n_a") + F.col("n_b"))


def _band(n, percent: int):
    """Size band: sizes of a linked pair differ by at most the factor 100 / percent, so by at most one band."""
    return F.floor(F.log(n) / F.lit(_step(percent))).cast("long")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their set sizes and the size of their intersection: a, b, n_a, n_b, both."""
    def run(batches):
        for batch in batches:
            out = [(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))
                   for x, y in zip(K.hash_sets(batch.column("x")), K.hash_sets(batch.column("y")))]
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *[pa.array(c, pa.int64()) for c in cols]],
                                             names=["a", "b", "n_a", "n_b", "both"])

    joined = (pairs.join(sets.select(F.col("digest").alias("a"), F.col("tokens").alias("x")), "a")
              .join(sets.select(F.col("digest").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y"))
    return joined.mapInArrow(run, "a binary, b binary, n_a bigint, n_b bigint, both bigint")


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``overlaps`` that reach the similarity."""
    return pairs.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def distinct_groups(sets: DataFrame) -> DataFrame:
    """(entry): one index entry for each set of two or more members that share an entry; written once."""
    members = sets.select(F.xxhash64("digest").alias("x"), F.xxhash64("digest", F.lit(1)).alias("y"), F.explode("entries").alias("entry"))
    groups = (members.groupBy("entry").agg(F.count(F.lit(1)).alias("members"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
              .where("members > 1"))
    return groups.groupBy("members", "x", "y").agg(F.min("entry").alias("entry")).select("entry").transform(cut)


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links (a, b) between distinct texts that connect all linked texts.

    ``sets`` are rows of ``candidates`` (materialised).  An entry's members are a
    star first, then what the star leaves apart is compared, where the overlaps
    with the centre allow a link.
    """
    groups = distinct_groups(sets)
    members = sets.select("digest", "n", "shared", F.explode("entries").alias("entry")).join(groups, "entry").transform(cut)
    # written, so that an entry with very many members can be split in the join
    centre = members.groupBy("entry").agg(F.max_by("digest", F.struct(
        F.col("shared") / F.col("n"), F.col("shared"), F.col("digest"))).alias("centre")).transform(cut)
    stars = members.join(centre, "entry").where("digest != centre").select(F.col("digest").alias("a"), F.col("centre").alias("b")).distinct()
    seen = overlaps(stars, sets).transform(cut)
    found = linked(seen, percent).transform(cut)
    # what is still apart: members outside the component of their entry's centre
    comp = connected_components(found).select(F.col("node").alias("digest"), "component")
    texts = sets.select("digest", "n", "shared", "entries").join(comp, "digest", "left").withColumn(
        "component", F.coalesce("component", "digest"))
    placed = (texts.select("digest", "n", "shared", "component", F.explode("entries").alias("entry")).join(centre, "entry").transform(cut))
    main = placed.where("digest = centre").select("entry", F.col("component").alias("main")).transform(cut)
    apart = placed.join(main, "entry").where("component != main").select("entry", "main").distinct().transform(cut)
    if apart.limit(1).count() == 0:
        return found
    with_centre = seen.select(F.col("a").alias("digest"), F.col("b").alias("centre"), "both")
    # entries of one centre with nearly the same members become one group, so that a pair is not met once per entry:
    # such sets mostly have the same smallest hash, sets without a common member never do
    placed = placed.join(apart, "entry")
    club = placed.where("digest != centre").groupBy("entry").agg(F.min(F.xxhash64("digest")).alias("club")).transform(cut)
    placed = (placed.join(club, "entry").drop("entry").distinct().join(with_centre, ["digest", "centre"], "left")
              .withColumn("both", F.coalesce("both", "n")).withColumn("band", _band(F.col("n"), percent)).transform(cut))

    def side(rows, x):
        return rows.select("centre", "club", "band", *[F.col(c).alias(f"{n}_{x}") for c, n in (
            ("digest", "d"), ("n", "n"), ("shared", "shared"), ("both", "both"), ("component", "component"))])

    stray = side(placed.where("component != main"), "a")
    other = side(placed.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)]))), "b")
    rest = (stray.join(other, ["centre", "club", "band"]).where((F.col("component_a") != F.col("component_b")) & _may_link(percent))
            .select(F.least("d_a", "d_b").alias("a"), F.greatest("d_a", "d_b").alias("b")).distinct())
    return found.unionAll(linked(overlaps(rest, sets), percent)).transform(cut)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT,
                    part_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, component_id, digest (of its shingle set).

    ``component_id`` is the smallest doc_id reachable over links.
    ``part_bytes`` and ``bucket_bytes`` are as in ``blobs.side_bytes``, the default.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    each = document_sets(rows, k).transform(cut)
    sets = candidates(rows.select("text"), k, percent, part_bytes, bucket_bytes).transform(cut)
    comp = connected_components(links(sets, percent))
    classes = each.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    linked = classes.join(comp.withColumnRenamed("node", "digest"), "digest")
    firsts = linked.groupBy("component").agg(F.min("first").alias("least"))
    least = linked.join(firsts, "component").select("digest", "least")
    named = classes.join(least, "digest", "left").select("digest", F.coalesce("least", "first").alias("_component")).transform(cut)
    # one written row per set on the right, so a set that a third of all rows share is split by adaptive skew joins
    return (each.join(named, "digest", "left")
            .select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                    F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("_component")).alias("component_id"),
                    "digest"))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, **kw) -> DataFrame:
    """``docs`` (all columns) with one document of each component: the one that names it.

    Rows that repeat that doc_id and text stay together; rows without id and texts without words stay.
    """
    names = docs.columns
    flat = near_duplicates(docs, k, percent, **kw)
    drop = (flat.where("doc_id IS NOT NULL AND component_id != doc_id")
            .select(F.col("doc_id").alias("_drop"), F.col("text_hash").alias("_hash")).distinct())
    kept = docs.join(drop, (docs["doc_id"].cast("long") == drop["_drop"]) & (F.xxhash64(docs["text"]) == drop["_hash"]),
                     "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in names])
