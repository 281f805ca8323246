"""Quality classifier: ordinal cumulative-link regression on hashed text.

One weight vector over hashed text features is shared by all grades; ordered
thresholds split its score s into P(grade >= j) = sigmoid(s - threshold_j).
A document gets its expected grade (the sum of these) and the tail
probability of the grade asked for, by which documents are selected.

Features are counts over words, divided by the number of words: the word, its
last two bytes, its shape (capitals, symbols, repeated nearby or inside a
repeated three-word run).

The model is fitted on at most ``TRAIN_ROWS`` labelled documents, chosen by a
seeded hash, inside one task; scoring is a narrow pass over all documents.

Edge cases: null and empty texts have no features and get the score 0 under
the thresholds; null grades and labels without a document are ignored;
several grades of one document count each; labelled texts over
``common.LONGEST_TEXT`` bytes are scored whole and fitted by pieces from all
over them; further columns are ignored, whatever their names; without labelled
rows all grades are equally likely; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm import kernels as K
from cohortkit.llm.common import labelled_sample

TRAIN_ROWS = 8_000    # bounds of the training sample
TRAIN_BYTES = 24 << 20
DIM_BITS = 16
STEPS = 150
RATE = 0.2
RIDGE = 1e-4
SELECT = 0.5
SEED = 11
_SYMBOLS = b"#$%&*!|<>^~_=@"


def doc_features(texts):
    """For each text of an Arrow column: (feature indices of all its words, words)."""
    data, off = K.utf8(texts)
    values = K.byte_values(lower=True)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(_SYMBOLS)] = True
    shift = np.uint64(64 - DIM_BITS)
    for i, j in K.chunks(off):
        part, po = data[off[i]:off[j]], off[i:j + 1] - off[i]
        starts, ends, woff = K.word_bounds(part, po, K.space_words())
        if not len(starts):
            for _ in range(j - i):
                yield np.zeros(0, np.int32), 0
            continue
        h = K.mix(K.span_hashes(K.byte_prefix(part, values), starts, ends))
        last = part[ends - 1].astype(np.uint64)
        before = np.where(ends - starts > 1, part[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        is_symbol = np.concatenate([[0], np.cumsum(symbol[part])])
        symbols = is_symbol[ends] - is_symbol[starts]
        is_upper = np.concatenate([[0], np.cumsum((part >= 65) & (part <= 90))])
        upper = (is_upper[ends] - is_upper[starts]) > 1
        doc = np.repeat(np.arange(j - i), np.diff(woff))
        again = np.zeros(len(h), dtype=bool)
        for lag in (1, 2, 3):
            same = (h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])
            again[lag:] |= same
        run = K.window_hashes(h, 3)
        if len(run):  # three-word runs seen earlier in the same document
            _, first, inv = np.unique(run ^ K.mix(doc[:len(run)].astype(np.uint64) + np.uint64(1)), return_index=True,
                                      return_inverse=True)
            again[:len(run)] |= (first[inv] != np.arange(len(run))) & (doc[:len(run)] == doc[2:])
        shape = (upper.astype(np.uint64) + np.uint64(2) * again.astype(np.uint64)
                 + np.uint64(4) * np.minimum(symbols, 3).astype(np.uint64))
        ids = np.stack([
            h >> shift,
            K.mix(last * np.uint64(257) + before + np.uint64(1 << 20)) >> shift,
            K.mix(shape + np.uint64(1 << 30)) >> shift], axis=1).astype(np.int32)
        for d in range(j - i):
            a, b = woff[d], woff[d + 1]
            yield ids[a:b].ravel(), int(b - a)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(features: list[np.ndarray], n_words: list[int], grades: np.ndarray, n_grades: int,
                steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> dict:
    """Maximum likelihood with Adam; thresholds stay ordered as increments are kept positive."""
    dim = 1 << DIM_BITS
    w = np.zeros(dim)
    seen = np.array([(grades >= j).mean() if len(grades) else 1 - j / n_grades for j in range(1, n_grades)])
    seen = np.clip(seen, 0.01, 0.99)
    theta = np.maximum.accumulate(-np.log(seen / (1 - seen)) + 0.01 * np.arange(n_grades - 1))
    if not len(grades):
        return {"w": w, "theta": theta}
    pairs = [np.unique(f, return_counts=True) for f in features]
    cols = np.concatenate([c for c, _ in pairs])
    row = np.repeat(np.arange(len(pairs), dtype=np.int32), [len(c) for c, _ in pairs])
    value = np.concatenate([k / max(n, 1) for (_, k), n in zip(pairs, n_words)])
    raw = np.concatenate([[theta[0]], np.log(np.expm1(np.maximum(np.diff(theta), 0.01)))])
    m, v, m2, v2 = np.zeros(dim), np.zeros(dim), np.zeros_like(raw), np.zeros_like(raw)
    at = np.arange(len(grades))
    for t in range(1, steps + 1):
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(raw[1:])))])
        s = np.bincount(row, w[cols] * value, minlength=len(grades))
        tail = _sigmoid(s[:, None] - theta[None, :])
        full = np.concatenate([np.ones((len(s), 1)), tail, np.zeros((len(s), 1))], axis=1)
        above, below = full[at, grades], full[at, grades + 1]
        p = np.maximum(above - below, 1e-12)
        slope = full * (1 - full)
        g_s = -(1 - above - below) / len(s)
        grad = np.bincount(cols, g_s[row] * value, minlength=dim) + ridge * w
        g_theta = np.zeros(n_grades + 1)
        np.add.at(g_theta, grades, slope[at, grades] / p)
        np.add.at(g_theta, grades + 1, -slope[at, grades + 1] / p)
        g_theta = g_theta[1:-1] / len(s)
        # chain rule through the increments
        tails = np.cumsum(g_theta[::-1])[::-1]
        g_raw = np.concatenate([[tails[0]], tails[1:] * _sigmoid(raw[1:])])
        for x, g, a, b in ((w, grad, m, v), (raw, g_raw, m2, v2)):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            x -= rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    theta = raw[0] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(raw[1:])))])
    return {"w": w, "theta": theta}


def fit(docs: DataFrame, grades: DataFrame, n_grades: int, train_rows: int = TRAIN_ROWS, seed: int = SEED) -> dict:
    """Model from ``grades`` (doc_id, grade in 0 .. n_grades - 1) and the documents' texts."""
    grades = grades.select("doc_id", F.col("grade").cast("int").alias("grade"))
    keep = F.col("grade").between(0, n_grades - 1)
    sample = labelled_sample(docs, grades, keep, train_rows, TRAIN_BYTES, seed).select("grade", "text")

    def train(batches):
        grade, n, feats = [], [], []
        for batch in batches:
            grade += batch.column("grade").to_pylist()
            for f, words in doc_features(batch.column("text")):
                feats.append(f)
                n.append(words)
        model = fit_ordinal(feats, n, np.array(grade, dtype=np.int64), n_grades)
        model["w"] = model["w"].astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary()), pa.array([len(grade)], pa.int64())],
                                         names=["model", "n"])

    # the sample is bounded in rows and bytes, so one task can hold it
    made = sample.repartition(1).mapInArrow(train, "model binary, n bigint").first()
    return pickle.loads(made[0]) if made else fit_ordinal([], [], np.zeros(0, dtype=np.int64), n_grades)


def score(docs: DataFrame, model: dict, tail: int = 1) -> DataFrame:
    """Every column of ``docs`` with ``expected_grade`` and ``tail_probability`` P(grade >= tail)."""
    names = [c for c in docs.columns if c not in ("expected_grade", "tail_probability")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col("text").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**DIM_BITS weights

    def run(batches):
        w, theta = held.value["w"].astype(np.float64), held.value["theta"]
        for batch in batches:
            s = np.array([w[f].sum() / n if n else 0.0 for f, n in doc_features(batch.column("text"))])
            tails = _sigmoid(s[:, None] - theta[None, :]) if len(s) else np.zeros((0, len(theta)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(tails.sum(axis=1)), pa.array(tails[:, tail - 1])],
                                             names=["doc", "expected_grade", "tail_probability"])

    schema = rows.select("doc", F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_probability")).schema
    return rows.mapInArrow(run, schema).select("doc.*", "expected_grade", "tail_probability")


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the labels table: 0 rejected, 1 good but toxic, 2 good."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).alias("grade"))
