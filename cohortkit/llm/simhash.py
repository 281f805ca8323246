"""SimHash near-duplicates with BK-trees.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles.  Distinct fingerprints are the nodes of the join, so exact copies
are one.  Two of them that differ in at most ``RADIUS`` = 2 of 64 bits agree in
two of the four 16-bit quarters, so each goes to the shards of its six pairs
of quarters.  Every shard has a BK-tree: children are keyed by their Hamming
distance to the parent, and a search follows only the edges whose distance is
within the radius of the distance to the node.  All trees together grow with
the corpus, so they are not broadcast: a tree is built where the fingerprints
that search it are, by one exchange.

A shard of more than ``LARGEST`` fingerprints is split the same way: its
other 32 bits are four bytes, of which two agree, so a shard of the second
level has 16 free bits, 65,536 fingerprints at most.  No tree exceeds that and
no link is lost.

A shard hands on a spanning forest of its links; components come from star
steps over them.

Edge cases: null and wordless texts have the fingerprint 0 and link like any
other; texts with fewer words than a shingle are one shingle; rows that share a
doc_id are judged by their texts; rows without doc_id link, but name no
component (null if no linked row has an id); repeated rows are copies; a very long
text is hashed whole, piece by piece; further columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm import kernels as K
from cohortkit.llm.common import BROADCAST_ROWS, cut
from cohortkit.operators.components import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42
LARGEST = 4096     # fingerprints in a shard of the first level; larger ones are split
PIECE = 1 << 16    # shingles whose bits are spread out at a time
LONG = 4096        # bytes from which on a shingle is hashed by itself

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of one byte array, lane by lane over all spans that are long enough."""
    size = ends - starts
    out = np.empty(len(starts), np.uint64)
    big = np.flatnonzero(size > LONG)
    for i in big.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), seed)
    few = np.flatnonzero(size <= LONG)
    order = few[np.argsort(size[few], kind="stable")]  # so the spans that go on are always the rest of the array
    size, at = size[order], starts[order].copy()
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    word8 = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    word4 = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))
    with np.errstate(over="ignore"):
        h = np.full(len(order), np.uint64(seed) + _P5)
        wide = int(np.searchsorted(size, 32))
        if wide < len(order):
            s = np.uint64(seed)
            acc = [np.full(len(order) - wide, v) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for stripe in range(1, int(size[-1]) // 32 + 1):
                k = int(np.searchsorted(size, 32 * stripe)) - wide
                for lane in range(4):
                    acc[lane][k:] = _round(acc[lane][k:], word8[at[wide + k:] + 8 * lane])
                at[wide + k:] += 32
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            h[wide:] = x
        h += size.astype(np.uint64)
        rest = size & 31
        zero = np.uint64(0)
        for _ in range(3):
            on = np.flatnonzero(rest >= 8)
            h[on] = _rotl(h[on] ^ _round(np.full(len(on), zero), word8[at[on]]), 27) * _P1 + _P4
            at[on] += 8
            rest[on] -= 8
        on = np.flatnonzero(rest >= 4)
        h[on] = _rotl(h[on] ^ (word4[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[on] += 4
        rest[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(rest > 0)
            h[on] = _rotl(h[on] ^ (raw[at[on]].astype(np.uint64) * _P5), 11) * _P1
            at[on] += 1
            rest[on] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    out[order] = h
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _one_space(data: np.ndarray, off: np.ndarray):
    """The lower-case words of some texts, one space after each: bytes, word starts and ends, word offsets by text."""
    starts, ends, woff = K.word_bounds(data, off, K.space_words())
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    spots = np.repeat(at - starts, size) + np.flatnonzero(K.space_words()[data])
    out[spots] = _LOWER[data[K.space_words()[data]]]
    return out, at, at + size, woff


def fingerprints(texts, k: int = SHINGLE) -> np.ndarray:
    """Fingerprints of an Arrow column of texts."""
    data, off = K.utf8(texts)
    out = np.zeros(len(off) - 1, np.uint64)
    for i, j in K.chunks(off):
        raw, starts, ends, woff = _one_space(data[off[i]:off[j]], off[i:j + 1] - off[i])
        n_words = np.diff(woff)
        n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))  # shingles of each text
        owner = np.repeat(np.arange(j - i), n)
        first = woff[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        last = np.minimum(first + k, woff[1:][owner]) - 1
        ones = np.zeros((j - i, 64), np.int64)
        for a in range(0, len(owner), PIECE):
            own = owner[a:a + PIECE]
            h = xxh64(raw, starts[first[a:a + PIECE]], ends[last[a:a + PIECE]])
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            ones[own[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
        out[i:j] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


def document_prints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (as a signed long) of every row."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), k).view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, fingerprint bigint")


class BKTree:
    """Children by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Indexes of the values within ``radius``; only edges within it of the distance to a node are followed."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) > 2 * radius:
                stack += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
            else:
                stack += [child for e, child in edges.items() if abs(e - d) <= radius]
        return found

    def add(self, value: int) -> int:
        """Index of ``value``, which is not in the tree yet."""
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while new:
            edges = self.children[at]
            d = (self.values[at] ^ value).bit_count()
            if d not in edges:
                edges[d] = new
                break
            at = edges[d]
        return new


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between distinct values that connect all that are within ``radius`` of each other, by one tree."""
    tree, root, out = BKTree(), [], []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for v in values:
        near = tree.near(v, radius)
        new = tree.add(v)
        root.append(new)
        for i in near:
            a, b = find(i), find(new)
            if a != b:
                root[b] = a
                out.append((tree.values[i], v))
    return out


def _agreeing(free: list, of: str = "fingerprint"):
    """One key for each pair of the four bit ranges (low bit, width): which pair, and its bits."""
    value = F.col(of)

    def bits(low: int, width: int):
        return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))

    keys = [F.struct(F.lit(p).alias("pair"), bits(*a).alias("x"), bits(*b).alias("y"))
            for p, (a, b) in enumerate(itertools.combinations(free, 2))]
    return F.explode(F.array(*keys))


QUARTERS = [(0, 16), (16, 16), (32, 16), (48, 16)]


def shards(prints: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(values): the fingerprints of every shard of two or more; ``prints`` holds distinct ones."""
    wide = prints.select("fingerprint", _agreeing(QUARTERS).alias("shard"))
    hot = wide.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest).select("shard").transform(cut)
    n_hot = hot.count()
    values = F.collect_list("fingerprint").alias("values")
    if not n_hot:
        return wide.groupBy("shard").agg(values).where(F.size("values") > 1).select("values")
    known = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    even = wide.join(known, "shard", "left_anti").groupBy("shard").agg(values)
    split = []
    for p, fixed in enumerate(itertools.combinations(QUARTERS, 2)):
        free = [(low + part, 8) for low, _ in QUARTERS if (low, 16) not in fixed for part in (0, 8)]
        split.append(wide.where(F.col("shard.pair") == p).join(known, "shard", "left_semi")
                     .select("fingerprint", "shard", _agreeing(free).alias("inner")))
    deep = split[0]
    for s in split[1:]:
        deep = deep.unionAll(s)
    return even.select("values").unionAll(deep.groupBy("shard", "inner").agg(values).select("values")).where(F.size("values") > 1)


def links(prints: DataFrame, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within ``radius`` (2 at most)."""
    if radius > RADIUS:
        raise ValueError(f"quarters find fingerprints that differ in {RADIUS} bits at most")

    def run(batches):
        for batch in batches:
            found = [link for values in batch.column("values").to_pylist()
                     for link in forest([v & 0xFFFFFFFFFFFFFFFF for v in sorted(values)], radius)]
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    return shards(prints, largest).mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """Per document: doc_id, fingerprint (signed long), component_id (smallest doc_id reachable)."""
    each = document_prints(docs, k).transform(cut)
    classes = each.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).transform(cut)
    comp = connected_components(links(classes.select("fingerprint"), radius, largest).transform(cut)).transform(cut)
    linked = classes.join(comp.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    linked = linked.withColumn("component", F.coalesce("component", "fingerprint"))
    # written, so that the join of all documents reads one plain row per fingerprint and can be split where one is hot
    named = linked.join(linked.groupBy("component").agg(F.min("first").alias("component_id")), "component").select(
        "fingerprint", "component_id").transform(cut)
    return each.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
