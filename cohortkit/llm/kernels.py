"""NumPy kernels that run inside Arrow tasks.

A whole Arrow batch is tokenised at once: words are found with a byte class
table, every word gets a 64-bit hash, and windows of k words get a
Rabin-Karp hash from prefix sums.  All arithmetic is modulo 2**64 with odd
bases, so a window hash is a difference of prefix sums times an inverse
power.  The package is pickled by value: executors need no copy of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
CHUNK = 1 << 20  # bytes tokenised at a time


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, in place on a copy."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict = {}


def _pow(base: int, n: int) -> np.ndarray:
    """Cached powers base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = powers(base, max(n, CHUNK + 1))
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


BYTE_INV = inverse(BYTE_BASE)
WORD_INV = inverse(WORD_BASE)


def byte_values(lower: bool) -> np.ndarray:
    """A pseudo-random 64-bit value per byte; A-Z share those of a-z if ``lower``."""
    ids = np.arange(256, dtype=np.uint64)
    if lower:
        ids[65:91] += np.uint64(32)
    return mix((ids + np.uint64(1)) * np.uint64(BYTE_BASE))


def space_words() -> np.ndarray:
    """Byte class of words that end at ASCII white space."""
    is_word = np.ones(256, dtype=bool)
    is_word[[9, 10, 11, 12, 13, 32]] = False
    return is_word


def alnum_words() -> np.ndarray:
    """Byte class of words of ASCII letters, digits and all non-ASCII characters."""
    is_word = np.zeros(256, dtype=bool)
    is_word[48:58] = is_word[65:91] = is_word[97:123] = is_word[128:] = True
    return is_word


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column (nulls become empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def hash_sets(column):
    """The 64-bit hashes of every row of an Arrow binary column, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offs, dtype=kind)[column.offset:column.offset + len(column) + 1].tolist()
    for a, b in zip(off[:-1], off[1:]):
        yield np.frombuffer(data, np.uint64, count=(b - a) // 8, offset=a) if b > a else np.zeros(0, np.uint64)


def chunks(off: np.ndarray, size: int = CHUNK):
    """Ranges [i, j) of documents of at most ``size`` bytes, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, off: np.ndarray, is_word: np.ndarray):
    """Byte starts and ends of all words, and the word offset of each document."""
    n = len(data)
    inside = is_word[data]
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = off[(off > 0) & (off < n)]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans from the prefix sums of ``byte_prefix``."""
    n = len(prefix)
    return (prefix[ends] - prefix[starts]) * _pow(BYTE_INV, n)[starts]


def byte_prefix(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * _pow(BYTE_BASE, len(data)), out=out[1:])
    return out


def word_hashes(data: np.ndarray, off: np.ndarray, is_word: np.ndarray, values: np.ndarray):
    """Hash of every word, and the word offset of each document, chunk by chunk."""
    hashes, offsets, base = [], [np.zeros(1, np.int64)], 0
    for i, j in chunks(off):
        part = data[off[i]:off[j]]
        starts, ends, woff = word_bounds(part, off[i:j + 1] - off[i], is_word)
        hashes.append(mix(span_hashes(byte_prefix(part, values), starts, ends)))
        offsets.append(woff[1:] + base)
        base += len(starts)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(offsets)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of the k words that start at each word (documents are not kept apart)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _pow(WORD_BASE, len(h)), out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * _pow(WORD_INV, n))


def window_valid(woff: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of those windows lie inside one document."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    left = np.zeros(n_words + 1, dtype=np.int64)  # words left in the document from each word on
    sizes = np.diff(woff)
    left[:n_words] = np.repeat(woff[1:], sizes) - np.arange(n_words)
    return left[:n] >= k


def distinct(values: np.ndarray, is_sorted: bool = False) -> np.ndarray:
    """Sorted distinct values; for 64-bit hashes sorting is far faster than the hash table of a bare ``np.unique``."""
    values = values if is_sorted else np.sort(values)
    if len(values) < 2:
        return values
    first = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def covered(hits: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Words covered by windows of k words that start at ``hits``."""
    step = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(step, hits, 1)
    np.add.at(step, hits + k, -1)
    return np.cumsum(step[:-1]) > 0


def doc_sums(values: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """Sum of a per-word array for each document (empty documents: 0)."""
    prefix = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=prefix[1:])
    return prefix[woff[1:]] - prefix[woff[:-1]]

