"""Compact exchange of 64-bit hashes between parts of a corpus.

A part (a few MB of text) sends the sorted distinct hashes of its windows to
hash-range buckets, one binary row per bucket: successive differences, byte
plane by byte plane, so that the upper planes are zeros that the shuffle's
compression removes.  A bucket sees all parts at once and answers each with
one small value per hash, in the order sent.  No hash travels as a row of its
own, and no hash table of the corpus exists anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

HASH_ROWS = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
HASH_SCHEMA = "bucket int, part bigint, n bigint, data binary"
ANSWER_ROWS = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
ANSWER_SCHEMA = "part bigint, bucket int, data binary"

SIDE_BYTES = 8 << 20        # text behind a part or a bucket, while that keeps blobs full
MOST_SIDE_BYTES = 64 << 20  # bounds the memory of a task (about 1 GB)
BLOB_HASHES = 64            # hashes a blob should hold


def side_bytes(size: int) -> int:
    """Text bytes per part and per bucket for a corpus of ``size`` bytes.

    Each part sends each bucket one blob, so a blob holds about
    side**2 / (7 size) hashes.  The side grows with the root of the corpus
    (from some 160 GB on) so that blobs do not shrink to single hashes.
    """
    return min(MOST_SIDE_BYTES, max(SIDE_BYTES, int((7 * BLOB_HASHES * size) ** 0.5)))


def encode(values: np.ndarray) -> bytes:
    """Sorted uint64 values as byte planes of their differences."""
    steps = np.empty_like(values)
    if len(values):
        steps[0] = values[0]
        np.subtract(values[1:], values[:-1], out=steps[1:])
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def decode(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8, count=8 * n).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def bucket_edges(values: np.ndarray, n_buckets: int, bits: int = 64) -> np.ndarray:
    """Offsets of the buckets (equal ranges of the upper bits) in sorted values below 2**bits."""
    top = (values >> np.uint64(max(bits - 32, 0))).astype(np.uint64)
    span = np.uint64(min(bits, 32))
    of = (top * np.uint64(n_buckets)) >> span
    return np.searchsorted(of, np.arange(n_buckets + 1, dtype=np.uint64))


def hash_rows(part: int, values: np.ndarray, n_buckets: int, bits: int = 64, extra: np.ndarray | None = None) -> pa.Table:
    """Rows of one part: a blob per bucket that has values (``extra``: one byte per value, appended)."""
    edges = bucket_edges(values, n_buckets, bits)
    rows = []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        i, j = edges[b], edges[b + 1]
        data = encode(values[i:j]) + (extra[i:j].tobytes() if extra is not None else b"")
        rows.append((b, part, int(j - i), data))
    cols = list(zip(*rows)) or [[]] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, HASH_ROWS)], schema=HASH_ROWS)


def gather(table: pa.Table):
    """All values of a bucket with the row each came from; rows in part order."""
    table = table.sort_by("part")
    parts, counts = table.column("part").to_pylist(), table.column("n").to_pylist()
    blobs = table.column("data").to_pylist()
    values = np.concatenate([decode(b, n) for b, n in zip(blobs, counts)])
    return parts, counts, blobs, values


def answers(parts, bucket: int, blobs) -> pa.Table:
    return pa.Table.from_arrays([pa.array(parts, pa.int64()), pa.array([bucket] * len(parts), pa.int32()),
                                 pa.array(blobs, pa.binary())], schema=ANSWER_ROWS)
