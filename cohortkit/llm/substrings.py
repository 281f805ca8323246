"""Substring deduplication with Rabin-Karp hashes of every fixed-length word window.

A window of 13 words is repeated when its word sequence also starts in a
document with a smaller ``doc_id``; covered words are removed and neighbouring
windows merge into maximal intervals.

Documents are cut into parts by ``doc_id`` range, in id order, at counted
quantiles of the ids, in two levels where there are over a thousand parts.  An
id that fills whole quantiles by itself has a rank of
its own and is dealt over several parts of that rank.  Each part
hashes its windows, finds repeats inside the part itself, and sends its
distinct hashes to hash-range buckets as compact blobs (see ``blobs``).  A
bucket tells each part, one bit per hash, whether a part of an earlier rank holds it.
The parts then mark, merge and cut.  Texts are shuffled once (both uses read
the same exchange), hashes once at some six bytes a window, answers at one bit.

Two windows are held equal when their 64-bit hashes agree.

Edge cases: null and empty texts have no words; rows without ``doc_id``
neither remove nor lose words; rows that share a ``doc_id`` never remove from
each other, as neither id is smaller, and may be a third of all rows; very long
texts are taken whole, so a part is as long as its longest text at least; further columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm import blobs as B
from cohortkit.llm import kernels as K
from cohortkit.session import cut

WINDOW = 13
SLICES = (64, 1024)      # doc_id quantiles, as many as parts within these bounds; beyond, slices have quantiles of their own
BROADCAST_CUTS = 2_000_000  # of eight bytes, one a part: some 128 TB of text; beyond, rows are joined with their slice's cuts
EXACT_DOUBLES = 2 ** 53
SUB_BITS = 20            # of a part number: the place within its rank

RESULT = "doc_id bigint, n_words bigint, spans array<struct<a:bigint,b:bigint>>, kept_sha256 string, kept string"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", _SPANS), ("kept_sha256", pa.string()),
                   ("kept", pa.string())])


def id_cuts(rows: DataFrame, slices: int) -> list[int]:
    """The ``slices`` + 1 quantiles of the ids, in order; empty without ids.

    Quantiles come as doubles, which tell ids beyond 2**53 apart by steps of
    up to 1,024 only.  Where one such value stands for several quantiles, the ids
    behind it are counted one by one, so that an id on a large share of the
    rows is known exactly.
    """
    cuts = rows.agg(F.approx_percentile("doc_id", [i / slices for i in range(slices + 1)], 100 * slices)).first()[0] or []
    rough = {c for c in cuts if abs(c) > EXACT_DOUBLES and cuts.count(c) > 1}
    if rough:
        near = F.col("doc_id").cast("double").isin([float(c) for c in rough])
        counted = rows.where(near).groupBy("doc_id").count().collect()  # a thousand ids a value at most
        for c in rough:
            own = sorted((r.doc_id, r["count"]) for r in counted if float(r.doc_id) == float(c))
            ends, n = list(accumulate(size for _, size in own)), cuts.count(c)
            exact = [own[bisect_right(ends, (j + 0.5) * ends[-1] / n)][0] for j in range(n)]
            cuts = [x for x in cuts if x != c] + exact
    return sorted(cuts)


def slice_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of the quantile slice of an id; equal cuts end no slice of their own."""
    limits = F.array(*[F.lit(int(c)) for c in sorted(set(cuts[1:-1]))]).cast("array<bigint>")
    return F.size(F.filter(limits, lambda c: doc_id >= c)).cast("long")


def fine_cuts(rows: DataFrame, cuts: list[int], per_slice: int) -> DataFrame:
    """(slice, fine): the quantiles of the ids inside every slice; ids that fill whole slices are left out.

    One narrow pass over the ids, counted from the start of their slice, so
    that dense ids stay apart as doubles (but for a slice that bridges a gap of
    over 2**53: ids beyond the gap are told apart by steps of up to 1,024).
    Written once, as an approximate quantile may come out differently when it
    is computed again.
    """
    heavy = [int(c) for c in set(cuts) if cuts.count(c) > 1]
    at = [j / per_slice for j in range(1, per_slice)]
    wide = F.col("doc_id").cast("decimal(20,0)")
    starts = F.array(*[F.lit(int(c)) for c in [cuts[0], *sorted(set(cuts[1:-1]))]]).cast("array<bigint>")
    start = F.element_at(starts, F.col("slice").cast("int") + 1).cast("decimal(20,0)")
    return (rows.where(F.col("doc_id").isNotNull() & ~F.col("doc_id").isin(heavy))
            .withColumn("slice", slice_of(F.col("doc_id"), cuts))
            .groupBy("slice").agg(F.approx_percentile(wide - start, at, 100 * per_slice).alias("fine"))
            .select("slice", F.transform("fine", lambda c: (c + start).try_cast("bigint")).alias("fine")).transform(cut))


def part_of(doc_id: Column, deal: Column, cuts: list[int], per_slice: int, fine: Column | None = None) -> Column:
    """Part number of an id: rank << SUB_BITS | place.

    The rank never falls as the id grows, and equal ids share it.  A quantile value that
    stands for several quantiles marks an id with that share of all rows: it
    has a rank to itself, with a place for each of its slices, dealt by ``deal``.
    ``fine`` holds the quantiles inside the slice of the id, where parts are
    smaller than slices; the same rule holds for them.
    """
    heavy = {c: cuts.count(c) * per_slice for c in set(cuts) if cuts.count(c) > 1}
    inside, place = F.lit(1).cast("long"), F.lit(0).cast("long")
    if fine is not None:
        known = F.coalesce(fine, F.array().cast("array<bigint>"))
        copies = F.size(F.filter(known, lambda c: c == doc_id))
        below = F.size(F.array_distinct(F.filter(known, lambda c: c <= doc_id)))
        inside = (2 * below + F.when(copies > 1, 0).otherwise(1)).cast("long")  # odd: between two cuts
        place = F.when(copies > 1, F.pmod(deal, copies)).otherwise(0)
    if heavy:  # a heavy id starts its slice
        share = F.lit(1)
        for c, n in heavy.items():
            share = F.when(doc_id == F.lit(int(c)), F.lit(n)).otherwise(share)
        is_heavy = doc_id.isin([int(c) for c in heavy])
        inside, place = F.when(is_heavy, F.lit(0)).otherwise(inside), F.when(is_heavy, F.pmod(deal, share)).otherwise(place)
    return (slice_of(doc_id, cuts) * (2 * per_slice + 2) + inside).cast("long") * F.lit(1 << SUB_BITS) + place.cast("long")


def with_parts(rows: DataFrame, cuts: list[int], per_slice: int) -> DataFrame:
    """``rows`` (doc_id, text) that have an id, with their ``part``."""
    known, fine = rows.where(F.col("doc_id").isNotNull()), None
    if per_slice > 1:
        table = fine_cuts(rows, cuts, per_slice)
        table = F.broadcast(table) if len(cuts) * per_slice <= BROADCAST_CUTS else table
        known = known.withColumn("slice", slice_of(F.col("doc_id"), cuts)).join(table, "slice", "left")
        fine = F.col("fine")
    return known.select(part_of(F.col("doc_id"), F.xxhash64("text"), cuts, per_slice, fine).alias("part"), "doc_id", "text")


def _windows(texts, window: int):
    """(word offsets, window starts, distinct hashes, their first window, inverse) of texts in order."""
    data, off = K.utf8(texts)
    h, woff = K.word_hashes(data, off, K.space_words(), K.byte_values(lower=False))
    starts = np.flatnonzero(K.window_valid(woff, len(h), window))
    hashes = K.window_hashes(h, window)[starts] if len(starts) else np.zeros(0, np.uint64)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return woff, starts, distinct, first, inverse


def _in_order(table: pa.Table) -> pa.Table:
    return table.select(["doc_id", "text"]).combine_chunks().sort_by("doc_id")


def _results(ids, texts, woff, hit, with_text: bool) -> pa.Table:
    """Result rows from the removed-word mask of all words."""
    n_words = np.diff(woff).tolist()
    spans, digests, kept_texts = [], [], []
    for i, n in enumerate(n_words):
        mask = hit[woff[i]:woff[i + 1]] if hit is not None else None
        words = (texts[i].as_py() or "").encode().split() if n else []
        if mask is not None and mask.any():
            edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
            spans.append([{"a": a, "b": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(),
                                                            np.flatnonzero(edge == -1).tolist())])
            words = compress(words, (~mask).tolist())
        else:
            spans.append([])
        kept = b" ".join(words)
        digests.append(hashlib.sha256(kept).hexdigest())
        kept_texts.append(kept.decode() if with_text else None)
    return pa.Table.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(spans, _SPANS),
                                 pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())], schema=_ROWS)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = False, part_bytes: int | None = None,
                     bucket_bytes: int | None = None) -> DataFrame:
    """Per document: doc_id, n_words, removed word intervals ``spans``, kept_sha256 and (on request) the kept text.

    ``part_bytes`` and ``bucket_bytes`` are the text behind a part and a bucket (default: ``blobs.side_bytes``).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bytes, bucket_bytes = part_bytes or B.side_bytes(size), bucket_bytes or B.side_bytes(size)
    slices = min(SLICES[1], max(SLICES[0], -(-size // part_bytes)))
    cuts = id_cuts(rows, slices)

    def plain(batches):
        for batch in batches:
            data, off = K.utf8(batch.column("text"))
            for i, j in K.chunks(off):
                _, woff = K.word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i], K.space_words(), K.byte_values(False))
                part = batch.slice(i, j - i)
                yield from _results(part.column("doc_id"), part.column("text"), woff, None, with_text).to_batches()

    nameless = rows.where(F.col("doc_id").isNull()).mapInArrow(plain, RESULT)
    if not cuts:
        return nameless
    per_slice = max(1, -(-size // (slices * part_bytes)))
    n_buckets = max(1, -(-size // bucket_bytes))
    known = with_parts(rows, cuts, per_slice)

    def send(key, table):
        distinct = _windows(_in_order(table).column("text"), window)[2]
        return B.hash_rows(key[0].as_py(), distinct, n_buckets)

    def answer(key, table):
        parts, counts, _, values = B.gather(table)
        order = np.argsort(values, kind="stable")  # parts in order within a value
        rank = np.repeat(np.array(parts, np.int64) >> SUB_BITS, counts)[order]
        ranked = values[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        again = np.zeros(len(values), dtype=bool)
        again[order] = rank > rank[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        edges = np.cumsum([0, *counts])
        bits = [np.packbits(again[i:j]).tobytes() for i, j in zip(edges[:-1], edges[1:])]
        said = [i for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if again[a:b].any()]
        return B.answers([parts[i] for i in said], key[0].as_py(), [bits[i] for i in said])

    def finish(key, left, right):
        own = _in_order(left)
        ids, texts = own.column("doc_id").combine_chunks(), own.column("text").combine_chunks()
        woff, starts, distinct, first, inverse = _windows(texts, window)
        edges = B.bucket_edges(distinct, n_buckets)
        earlier = np.zeros(len(distinct), dtype=bool)
        for b, data in zip(right.column("bucket").to_pylist(), right.column("data").to_pylist()):
            i, j = edges[b], edges[b + 1]
            earlier[i:j] = np.unpackbits(np.frombuffer(data, np.uint8), count=j - i).astype(bool)
        number = np.asarray(ids)
        doc = number[np.searchsorted(woff, starts, side="right") - 1]  # doc_id of each window
        repeated = earlier[inverse] | (doc[first][inverse] < doc) if len(starts) else np.zeros(0, bool)
        hit = K.covered(starts[repeated], int(woff[-1]), window)
        return _results(ids, texts, woff, hit, with_text)

    sent = known.groupBy("part").applyInArrow(send, B.HASH_SCHEMA)
    said = sent.groupBy("bucket").applyInArrow(answer, B.ANSWER_SCHEMA)
    done = known.groupBy("part").cogroup(said.groupBy("part")).applyInArrow(finish, RESULT)
    return done.unionByName(nameless)
