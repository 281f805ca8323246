"""Toxicity with a linear-chain conditional random field.

Tokens are labelled from labelled documents: a token of a toxic document is
toxic when its word, or a prefix of it, is far more common in toxic documents
than in others (by document counts).  A two-state chain with hashed word and
prefix features and learned transitions is fitted to these tokens.  Forward
and backward passes give each token's marginal; marginals add up to a document
score through a logistic curve fitted to the document labels, and tokens with
marginals of one half or more give the offending spans.

Texts are cut into chains of ``CHAIN`` words, all of them, so passes run over
many chains at once.  Fitting uses at most ``TRAIN_ROWS`` labelled documents
inside one task; scoring is a narrow pass.

Edge cases: null and empty texts have no tokens and get the curve's score of
no toxic mass; null labels and labels without a document are ignored; labelled
texts over ``common.LONGEST_TEXT`` bytes are scored whole and fitted by pieces
from all over them; further columns are ignored, whatever their names; without
both labels in the sample all scores are the share of toxic labels; rows
without ``doc_id`` count as not held out; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm import kernels as K
from cohortkit.llm.common import labelled_sample

TRAIN_ROWS = 12_000   # bounds of the training sample
TRAIN_BYTES = 24 << 20
FOLDS = 5             # rows of fold 0 are held out
CHAIN = 64
DIM_BITS = 18
PREFIXES = (3, 4, 5, 6, 7, 8)   # bytes
MIN_DOCS = 5          # toxic documents behind a token label
MIN_ODDS = 3.0        # log odds of toxic against other documents
STEPS = 60
RATE = 0.3
RIDGE = 1e-5
CLEAN_SHARE = 2       # clean documents per toxic one when the chain is fitted
SEED = 5


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """Remainder of the CRC-32 of the id as text; rows without an id are in no held-out fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(1).cast("long"))


def token_features(data: np.ndarray, off: np.ndarray):
    """(feature indices [words, 1 + prefixes], byte starts, byte ends, word offsets) of a run of texts."""
    starts, ends, woff = K.word_bounds(data, off, K.alnum_words())
    prefix = K.byte_prefix(data, K.byte_values(lower=True))
    shift = np.uint64(64 - DIM_BITS)
    cols = [K.mix(K.span_hashes(prefix, starts, ends)) >> shift]
    for n in PREFIXES:
        cut = np.minimum(starts + n, ends)
        cols.append(K.mix(K.span_hashes(prefix, starts, cut) + np.uint64(n)) >> shift)
    return np.stack(cols, axis=1).astype(np.int32), starts, ends, woff


def chains(woff: np.ndarray):
    """Start and length of the chains: runs of at most CHAIN words of one document."""
    sizes = np.diff(woff)
    n = -(-sizes // CHAIN)
    which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(woff[:-1], n) + CHAIN * which
    return start, np.minimum(CHAIN, np.repeat(woff[1:], n) - start)


def _log_ratio(x, a, b, c, d):
    """log((e^a + e^(x + b)) / (e^c + e^(x + d)))"""
    return np.logaddexp(a, x + b) - np.logaddexp(c, x + d)


def passes(u: np.ndarray, trans: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Forward and backward log ratios of state 1 against 0 for every token."""
    r, back = np.zeros(len(u)), np.zeros(len(u))
    if not len(start):
        return r, back
    r[start] = u[start]
    steps = int(length.max())
    for t in range(1, steps):
        at = start[length > t] + t
        r[at] = u[at] + _log_ratio(r[at - 1], trans[0, 1], trans[1, 1], trans[0, 0], trans[1, 0])
    for t in range(steps - 2, -1, -1):
        at = start[length > t + 1] + t
        back[at] = _log_ratio(u[at + 1] + back[at + 1], trans[1, 0], trans[1, 1], trans[0, 0], trans[0, 1])
    return r, back


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def marginals(feats: np.ndarray, woff: np.ndarray, model: dict) -> np.ndarray:
    u = np.clip(model["w"][feats].sum(axis=1) + model["bias"], -30, 30)
    start, length = chains(woff)
    r, back = passes(u, model["trans"], start, length)
    return _sigmoid(r + back)


def token_labels(feats, doc, toxic, n_docs) -> np.ndarray:
    """Label 1 for tokens of toxic documents with a feature that marks toxic documents."""
    dim = 1 << DIM_BITS
    n_toxic = max(1, int(toxic.sum()))
    label = np.zeros(len(feats), dtype=bool)
    for c in range(feats.shape[1]):
        pairs = K.distinct(doc.astype(np.int64) * dim + feats[:, c])
        is_toxic = toxic[pairs // dim]
        a = np.bincount(pairs[is_toxic] % dim, minlength=dim)
        b = np.bincount(pairs[~is_toxic] % dim, minlength=dim)
        odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_docs - n_toxic + 1))
        label |= ((a >= MIN_DOCS) & (odds >= MIN_ODDS))[feats[:, c]]
    return label & toxic[doc]


def fit_chain(feats, woff, y, steps=STEPS, rate=RATE, ridge=RIDGE) -> dict:
    """Maximum likelihood of the token labels under the chain, with Adam."""
    dim, k = 1 << DIM_BITS, feats.shape[1]
    start, length = chains(woff)
    flat = feats.ravel()
    inner = np.ones(len(y), dtype=bool)  # tokens that have a successor in their chain
    inner[start + length - 1] = False
    now = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[now].astype(int), y[now + 1].astype(int)), 1)
    x = np.zeros(dim + 5)  # weights, bias, transitions
    m, v = np.zeros_like(x), np.zeros_like(x)
    x[dim] = -2.0
    scale = 1.0 / max(1, len(start))
    for t in range(1, steps + 1):
        trans = x[dim + 1:].reshape(2, 2)
        u = np.clip(x[:dim][flat].reshape(-1, k).sum(axis=1) + x[dim], -30, 30)
        r, back = passes(u, trans, start, length)
        g_u = (_sigmoid(r + back) - y) * scale
        nxt = u[now + 1] + back[now + 1]
        logs = np.stack([trans[0, 0] + 0 * nxt, trans[0, 1] + nxt, r[now] + trans[1, 0], r[now] + trans[1, 1] + nxt])
        logs -= logs.max(axis=0)
        mass = np.exp(logs)
        pair = (mass / mass.sum(axis=0)).sum(axis=1).reshape(2, 2)
        g = np.concatenate([np.bincount(flat, np.repeat(g_u, k), minlength=dim), [g_u.sum()],
                            ((pair - seen) * scale).ravel()]) + ridge * x
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-10)
    return {"w": x[:dim].astype(np.float32), "bias": float(x[dim]), "trans": x[dim + 1:].reshape(2, 2).copy()}


def _curve_inputs(mass, n_words):
    return np.stack([np.ones(len(mass)), np.log(mass + 0.01), np.log1p(n_words)], axis=1)


def fit_curve(mass, n_words, toxic) -> np.ndarray:
    """Logistic regression of the document label on its toxic mass and length (Newton steps)."""
    x, beta = _curve_inputs(mass, n_words), np.zeros(3)
    for _ in range(25):
        p = _sigmoid(x @ beta)
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(3)
        beta = beta + np.linalg.solve(hess, x.T @ (toxic - p) - 1e-3 * beta)
    return beta


def fit_texts(texts: pa.Array, toxic: np.ndarray) -> dict:
    """Model from an Arrow column of texts and their labels."""
    dim = 1 << DIM_BITS
    empty = {"w": np.zeros(dim, np.float32), "bias": -10.0, "trans": np.zeros((2, 2))}
    share = np.clip(toxic.mean() if len(toxic) else 0.0, 1e-3, 1 - 1e-3)
    if not toxic.any() or toxic.all():
        return empty | {"curve": np.array([np.log(share / (1 - share)), 0.0, 0.0])}
    data, off = K.utf8(texts)
    parts = [token_features(data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in K.chunks(off)]
    feats = np.concatenate([p[0] for p in parts])
    woff = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[3]) for p in parts]))])
    doc = np.repeat(np.arange(len(toxic)), np.diff(woff))
    y = token_labels(feats, doc, toxic, len(toxic))
    # the chain sees all toxic documents and the first clean ones of the (hash ordered) sample
    clean = np.flatnonzero(~toxic)[:CLEAN_SHARE * int(toxic.sum())]
    use = np.sort(np.concatenate([np.flatnonzero(toxic), clean]))
    taken = np.isin(doc, use)
    sizes = np.diff(woff)[use]
    model = fit_chain(feats[taken], np.concatenate([[0], np.cumsum(sizes)]), y[taken].astype(np.float64))
    mass = np.concatenate([K.doc_sums(marginals(p[0], p[3], model), p[3]) for p in parts])
    return model | {"curve": fit_curve(mass, np.diff(woff), toxic.astype(float))}


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = SEED) -> dict:
    """Model from ``labels`` (doc_id, toxic), without the held-out fold."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    keep = F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)
    sample = labelled_sample(docs, labels, keep, train_rows, TRAIN_BYTES, seed).select(
        F.xxhash64("text", F.lit(seed)).alias("o"), "toxic", "text")

    def train(batches):
        some = [b for b in batches if b.num_rows]
        if some:
            table = pa.Table.from_batches(some).sort_by([("o", "ascending"), ("toxic", "ascending")])
            toxic = np.array(table.column("toxic").to_pylist(), dtype=bool)
            model = fit_texts(table.column("text").combine_chunks(), toxic)
        else:
            model = fit_texts(pa.array([], pa.string()), np.zeros(0, dtype=bool))
        n = sum(b.num_rows for b in some)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary()), pa.array([n], pa.int64())],
                                         names=["model", "n"])

    # the sample is bounded in rows and bytes, so one task can hold it
    made = sample.repartition(1).mapInArrow(train, "model binary, n bigint").first()
    return pickle.loads(made[0]) if made else fit_texts(pa.array([], pa.string()), np.zeros(0, dtype=bool))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per document: doc_id, score, toxic_mass, spans of offending words (code points, end exclusive)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**DIM_BITS weights
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, off = K.utf8(batch.column("text"))
            scores, masses, spans = [], [], []
            for i, j in K.chunks(off):
                part, po = data[off[i]:off[j]], off[i:j + 1] - off[i]
                feats, starts, ends, woff = token_features(part, po)
                p = marginals(feats, woff, held.value)
                mass = K.doc_sums(p, woff)
                scores.append(_sigmoid(_curve_inputs(mass, np.diff(woff)) @ held.value["curve"]))
                masses.append(mass)
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])  # code points before each byte
                found = [[] for _ in range(j - i)]
                hot = np.flatnonzero(p >= 0.5)
                owner = np.searchsorted(woff, hot, side="right") - 1
                for d, x in zip(owner.tolist(), hot.tolist()):
                    base = points[po[d]]
                    found[d].append({"start": int(points[starts[x]] - base), "end": int(points[ends[x]] - base)})
                spans += found
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64()),
                 pa.array(np.concatenate(masses) if masses else [], pa.float64()), pa.array(spans, span)],
                names=["doc_id", "score", "toxic_mass", "spans"])

    return rows.mapInArrow(run, "doc_id bigint, score double, toxic_mass double, spans array<struct<start:bigint,end:bigint>>")
