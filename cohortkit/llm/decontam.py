"""Benchmark decontamination by winnowing.

Documents and benchmark items become word sequences.  Of every six
consecutive 5-word hashes the smallest is kept as a fingerprint (rightmost on
ties), so any shared span of 6 + 5 - 1 = 10 words keeps a fingerprint common
to both sides, at the same place of the span.  Fingerprints that meet are
extended: the 10-word windows around a hit are compared with the benchmark's
windows, and every match marks its words.  Items of fewer than ten words are
one window of their own length, looked up at every position (a winnowing
window of one), as no shorter guarantee covers them.

The benchmark's windows are cut into blocks of at most ``BLOCK_WINDOWS`` rows;
a block is broadcast, so its size is bounded whatever the benchmark holds.
One block, the usual case, is a single narrow pass over the documents.  With
more blocks each makes a pass and the spans are merged per distinct text.

Edge cases: null and empty texts have no words; items without words match
nothing; rows of one ``item_id`` are one item, a null ``item_id`` is the item
named by the empty string; repeated rows and ties are judged on their own;
very long texts are searched whole; further columns are ignored or handed on
(``clean_documents``), whatever their names; an empty benchmark marks nothing,
an empty document table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm import kernels as K
from cohortkit.llm.common import cut

WINDOW = 10
GRAM = 5
BLOCK_WINDOWS = 500_000  # 8-byte window hashes with their item: some 30 MB a block

RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def hash_words(data: np.ndarray, off: np.ndarray):
    return K.word_hashes(data, off, K.alnum_words(), K.byte_values(lower=True))


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Which grams are the (rightmost) minimum of some window of ``width`` grams."""
    keep = np.zeros(len(grams), dtype=bool)
    n = len(grams) - width + 1
    if n <= 0:
        return keep
    best, at = grams[width - 1:].copy(), np.arange(width - 1, len(grams))
    for back in range(1, width):  # right to left: an equal gram further left loses
        other = grams[width - 1 - back:len(grams) - back]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + width - 1 - back
    keep[at] = True
    return keep


def item_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Benchmark windows (item_id, size, window hash, fingerprint hashes): one row per window.

    ``fingerprint`` is the smallest gram of the window; windows of short items
    have none.
    """
    def run(batches):
        for batch in batches:
            data, off = K.utf8(batch.column(1))
            h, woff = hash_words(data, off)
            ids = batch.column(0).to_pylist()
            rows = {"item_id": [], "size": [], "hash": [], "fp": []}
            for i, item in enumerate(ids):
                own = h[woff[i]:woff[i + 1]]
                size = min(len(own), window)
                if not size:
                    continue
                hashes = K.window_hashes(own, size)
                if size == window:
                    grams = K.window_hashes(own, gram)
                    width = window - gram + 1
                    fps = np.min(np.lib.stride_tricks.sliding_window_view(grams, width), axis=1).view(np.int64).tolist()
                else:
                    fps = [None] * len(hashes)
                rows["item_id"] += [item or ""] * len(hashes)
                rows["size"] += [size] * len(hashes)
                rows["hash"] += hashes.view(np.int64).tolist()
                rows["fp"] += fps
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(
                [("item_id", pa.string()), ("size", pa.int32()), ("hash", pa.int64()), ("fp", pa.int64())]))

    texts = benchmark.select(F.col("item_id").cast("string"), F.col("text"))
    return texts.mapInArrow(run, "item_id string, size int, hash bigint, fp bigint").distinct()


class Block:
    """The windows of one block, sorted for lookups; small enough to broadcast."""

    def __init__(self, rows):
        self.items = np.array([r["item_id"] for r in rows], dtype=object)
        order = np.argsort(np.array([r["hash"] for r in rows], dtype=np.int64), kind="stable") if rows else np.zeros(0, int)
        self.items = self.items[order]
        self.hash = np.array([rows[i]["hash"] for i in order], dtype=np.int64)
        self.size = np.array([rows[i]["size"] for i in order], dtype=np.int64)
        self.fps = np.unique(np.array([r["fp"] for r in rows if r["fp"] is not None], dtype=np.int64))
        self.bits = np.zeros(1 << 20, dtype=bool)  # quick answer before the binary search
        self.bits[self.fps & 0xFFFFF] = True
        self.hash_bits = np.zeros(1 << 20, dtype=bool)
        self.hash_bits[self.hash & 0xFFFFF] = True
        self.short = [int(s) for s in np.unique(self.size) if s < WINDOW]

    def find(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into ``hashes``, index into the block) of equal windows of ``size`` words."""
        lo, hi = np.searchsorted(self.hash, hashes, "left"), np.searchsorted(self.hash, hashes, "right")
        counts = hi - lo
        where = np.repeat(np.arange(len(hashes)), counts)
        which = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
        same = self.size[which] == size
        return where[same], which[same]


def match_block(h: np.ndarray, woff: np.ndarray, block: Block, window: int = WINDOW, gram: int = GRAM):
    """Matches in a run of documents: (start word, window size, block row) arrays."""
    found = []
    n = len(h)
    if len(block.fps) and n >= window:
        grams = K.window_hashes(h, gram).view(np.int64)
        maybe = block.bits[grams & 0xFFFFF]
        if maybe.any():
            marked = winnow(grams.view(np.uint64), window - gram + 1) & maybe
            at = np.flatnonzero(marked)
            at = at[np.isin(grams[at], block.fps)]
            # extend: all windows that hold the fingerprint and stay in its document
            starts = (at[:, None] - np.arange(window - gram + 1)[None, :]).ravel()
            starts = K.distinct(starts[(starts >= 0) & (starts <= n - window)])
            starts = starts[K.window_valid(woff, n, window)[starts]]
            if len(starts):
                hashes = K.window_hashes(h, window).view(np.int64)[starts]
                where, which = block.find(hashes, window)
                found.append((starts[where], np.full(len(where), window), which))
    for size in block.short:
        hashes = K.window_hashes(h, size).view(np.int64)
        starts = np.flatnonzero(block.hash_bits[hashes & 0xFFFFF] & K.window_valid(woff, n, size)) if len(hashes) else []
        if len(starts):
            where, which = block.find(hashes[starts], size)
            found.append((starts[where], np.full(len(where), size), which))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(3))


def _items_digest(names) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _hits(starts, sizes, n_words: int) -> np.ndarray:
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + sizes, -1)
    return np.cumsum(step[:-1]) > 0


def _document_rows(batch, block: Block):
    """Per document of a batch: (words, start words, sizes, item names)."""
    data, off = K.utf8(batch.column("text"))
    for i, j in K.chunks(off):
        h, woff = hash_words(data[off[i]:off[j]], off[i:j + 1] - off[i])
        starts, sizes, which = match_block(h, woff, block)
        owner = np.searchsorted(woff, starts, side="right") - 1
        by_doc: dict[int, list[int]] = {}
        for m, d in enumerate(owner.tolist()):
            by_doc.setdefault(d, []).append(m)
        for d in range(j - i):
            own = by_doc.get(d, ())
            yield (int(woff[d + 1] - woff[d]), starts[list(own)] - woff[d] if own else None,
                   sizes[list(own)] if own else None, {block.items[which[m]] for m in own})


def blocks(spark, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS):
    """Broadcast blocks of the benchmark's windows, each of bounded size (checked by a count), one at a time."""
    wins = item_windows(benchmark).persist()
    n = max(1, -(-wins.count() // block_windows))
    for b in range(n):
        # a hash bucket is near n-th of the rows; windows of one text share a bucket
        rows = wins.where(F.pmod(F.xxhash64("item_id", "hash"), F.lit(n)) == b).collect()
        if b == n - 1:
            wins.unpersist()
        yield n, spark.sparkContext.broadcast(Block(rows))


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    parts = blocks(spark, benchmark, block_windows)
    n_blocks, block = next(parts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if n_blocks == 1:
        def run(batches):
            schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                                ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
            for batch in batches:
                out = []
                for n, starts, sizes, names in _document_rows(batch, block.value):
                    hit = int(_hits(starts, sizes, n).sum()) if starts is not None else 0
                    out.append((n, hit, len(names), _items_digest(names), hit > 0))
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c, t.type) for c, t in zip(cols, list(schema)[1:])]], schema=schema)

        return rows.mapInArrow(run, RESULT)
    # the driver holds one block at a time: its pass is written before the next one is made
    merged, number = _block_pass(rows, block, 0).transform(cut), 0
    block.destroy()
    for _, block in parts:
        number += 1
        merged = merged.unionByName(_block_pass(rows, block, number).transform(cut))
        block.destroy()
    # one group per distinct (doc_id, text): at most one row per block and copy after the first step
    merged = (merged.groupBy("doc_id", "digest", "block", "n_words").agg(
        F.count(F.lit(1)).alias("copies"), F.first("spans").alias("spans"), F.first("items").alias("items"))
        .groupBy("doc_id", "digest", "n_words").agg(
            F.max("copies").alias("copies"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("end"))
    hit = F.aggregate(F.sort_array("spans"), zero, lambda s, x: F.struct(
        (s["total"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("total"),
        F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["total"])
    return (merged.withColumn("n_hit", hit)
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated")))


def _block_pass(rows: DataFrame, block, number: int) -> DataFrame:
    """One block against all documents: merged spans and items per document row; only the first one has rows without a hit."""
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("block", pa.int64()), ("n_words", pa.int64()),
                        ("spans", span), ("items", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for text, (n, starts, sizes, names) in zip(texts, _document_rows(batch, block.value)):
                spans = []
                if starts is not None:
                    hit = np.concatenate([[False], _hits(starts, sizes, n), [False]]).astype(np.int8)
                    edge = np.diff(hit)
                    spans = [{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                out.append((hashlib.sha256((text or "").encode()).digest(), number, n, spans, sorted(names)))
            cols = list(zip(*out)) or [[]] * 5
            keep = pa.array([number == 0 or bool(x) for x in cols[3]], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t.type) for c, t in zip(cols, list(schema)[1:])]], schema=schema).filter(keep)

    return rows.mapInArrow(run, "doc_id bigint, digest binary, block bigint, n_words bigint, "
                                "spans array<struct<a:bigint,b:bigint>>, items array<string>")


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` (all columns) without the documents that hold a benchmark window; one narrow pass per block."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col("text").alias("text"))
    for _, block in blocks(docs.sparkSession, benchmark, block_windows):
        def run(batches, block=block):
            for batch in batches:
                clean = [starts is None for _, starts, _, _ in _document_rows(batch, block.value)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("doc.*")
