"""K-Means over a k range on a weighted coreset.

All k and restarts are fitted on one bounded weighted sample of the customers
(``coreset``), one Spark task per few fits; one pass over all rows then labels
them for every k.  The loss of any centres on the sample stays within a stated
bound of their loss on all rows.  All labelings are scored together: WCSS /
Davies-Bouldin / Calinski-Harabasz from grouped aggregates, the
squared-distance silhouette from one linear pass.  The Euclidean silhouette
(F10) is a separate operator over all pairs, or over cell summaries with a bound.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.operators.boxes import leaves_of, median_tree
from cohortkit.operators.cluster_metrics import combined_score, label_metrics, select_k, squared_silhouette
from cohortkit.operators.pairs import distance_sums
from cohortkit.session import cut

SEED = 42
CORESET = 40_000  # expected rows of the weighted sample that models are fitted on
MAX_ITER = 300
SPLIT_SAMPLE = 50_000  # rows that the split is made from


def assemble(df: DataFrame, feats: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=feats, outputCol=out).transform(df)


def coreset(data: DataFrame, feats: list[str], size: int = CORESET, seed: int = SEED, id_col: str = "customer_id"):
    """(points, weights): a lightweight coreset (Bachem, Lucic and Krause, 2018), some ``size`` rows whatever the table holds.

    A row is drawn with probability p = size (1 / 2n + d2 / 2 sum of d2), d2
    its squared distance to the mean, and weighs 1 / p; the coin is a seeded
    hash of the customer, so reruns agree.  Up to size / 2 rows all are drawn with
    weight 1, and the fit is the fit of all rows.  Beyond that the loss of any k
    centres on the coreset differs from their loss on all rows by at most
    e / 2 (that loss + the loss of the mean alone), where e falls as
    sqrt(d k log k / size).  Two aggregates over the table.  Rows with a null feature are not drawn.
    """
    data = data.dropna(subset=feats)
    stats = data.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m{j}") for j, f in enumerate(feats)],
                     *[F.var_pop(f).alias(f"v{j}") for j, f in enumerate(feats)]).first()
    n, spread = stats["n"], sum(stats[f"v{j}"] or 0.0 for j in range(len(feats)))
    if not n:
        return np.zeros((0, len(feats))), np.zeros(0)
    d2 = sum(((F.col(f) - F.lit(float(stats[f"m{j}"]))) ** 2 for j, f in enumerate(feats)), F.lit(0.0))
    share = F.lit(0.5) + F.lit(0.5) * (d2 / F.lit(float(spread)) if spread > 0 else F.lit(1.0))
    p = F.least(F.lit(1.0), F.lit(float(size) / n) * share)
    coin = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = data.where(coin < p).select(id_col, *feats, (F.lit(1.0) / p).alias("_w")).toPandas().sort_values(id_col)
    return rows[feats].to_numpy(dtype=float), rows["_w"].to_numpy(dtype=float)


def _kmeanspp(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ seeding."""
    p = w / w.sum()
    centres = [x[rng.choice(len(x), p=p)]]
    d2 = ((x - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        prob = w * d2
        tot = prob.sum()
        centres.append(x[rng.choice(len(x), p=prob / tot if tot > 0 else p)])
        d2 = np.minimum(d2, ((x - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * x @ c.T, 0.0)


def lloyd(x: np.ndarray, w: np.ndarray, centres: np.ndarray, tol: float, max_iter: int = MAX_ITER):
    """(centres, inertia, iterations, converged) of weighted Lloyd steps from ``centres``."""
    k, it, done = len(centres), 0, False
    while it < max_iter and not done:
        lab = squared_distances(x, centres).argmin(1)
        mass = np.bincount(lab, w, k)
        sums = np.stack([np.bincount(lab, w * col, k) for col in x.T], 1)
        new = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
        done = float(((new - centres) ** 2).sum()) <= tol
        centres, it = new, it + 1
    return centres, float((w * squared_distances(x, centres).min(1)).sum()), it, done


def kmeans_batch(data: DataFrame, feats: list[str], ks: list[int], n_init: int = 10, seed: int = SEED,
                 max_iter: int = MAX_ITER, tol: float = 1e-4, size: int = CORESET) -> list[dict]:
    """F8 for many (k, restart) at once, on one coreset.

    The coreset (some megabytes at most) is broadcast; every fit is weighted k-means++
    and Lloyd steps in a task.  Convergence as the common rule: total squared centre shift <= tol * mean
    feature variance; a restart that ``max_iter`` stops is reported.
    Returns one dict per restart: k, seed, centres, inertia (on the coreset), iterations, converged.
    """
    spark = data.sparkSession
    x, w = coreset(data, feats, size, seed)
    if not len(x):
        raise ValueError("no rows to cluster")
    mean = np.average(x, axis=0, weights=w)
    limit = tol * float(np.average((x - mean) ** 2, axis=0, weights=w).mean())
    shared = spark.sparkContext.broadcast((x, w))
    d = len(feats)

    def fit(it):
        px, pw = shared.value
        for pdf in it:
            rows = []
            for k, s in zip(pdf["k"], pdf["seed"]):
                start = _kmeanspp(px, pw, min(int(k), len(px)), np.random.default_rng(int(s)))
                c, inertia, steps, done = lloyd(px, pw, start, limit, max_iter)
                rows.append((int(k), int(s), inertia, steps, done, c.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["k", "seed", "inertia", "iterations", "converged", "centres"])

    # large k first, dealt one by one, so that tasks end together
    todo = spark.sparkContext.parallelize([(k, seed + i) for k in sorted(ks, reverse=True) for i in range(n_init)], len(ks) * n_init)
    found = spark.createDataFrame(todo, "k int, seed int").mapInPandas(
        fit, "k int, seed int, inertia double, iterations int, converged boolean, centres array<double>").collect()
    shared.unpersist()
    models = [{"k": r.k, "seed": r.seed, "centres": np.array(r.centres).reshape(-1, d), "inertia": r.inertia,
               "iterations": r.iterations, "converged": r.converged} for r in found]
    if not all(m["converged"] for m in models):
        warnings.warn(f"K-Means: {sum(not m['converged'] for m in models)} restarts stopped at {max_iter} iterations", stacklevel=2)
    return models


def best_per_k(models: list[dict]) -> dict:
    out = {}
    for m in models:
        cur = out.get(m["k"])
        if cur is None or (m["inertia"], m["seed"]) < (cur["inertia"], cur["seed"]):
            out[m["k"]] = m
    return out


def nearest(feats: list[str], centres: np.ndarray):
    """Index of the nearest centre as a JVM expression (centres are literals)."""
    dists = [sum(((F.col(f) - F.lit(float(c[j]))) ** 2 for j, f in enumerate(feats)), F.lit(0.0))
             for c in centres]
    arr = F.array(*dists)
    return (F.array_position(arr, F.array_min(arr)) - 1).cast("int")


def assign(df: DataFrame, feats: list[str], centres: np.ndarray, out: str) -> DataFrame:
    return df.withColumn(out, nearest(feats, centres))


def lloyd_steps(data: DataFrame, feats: list[str], start: list, steps: int, id_col: str = "customer_id") -> DataFrame:
    """Labels and squared distances after ``steps`` Lloyd steps over all rows from given centres; an empty cluster keeps its centre."""
    centres = np.array(start, dtype=float)
    for _ in range(steps):
        means = assign(data, feats, centres, "_c").groupBy("_c").agg(*[F.avg(f).alias(f"m{j}") for j, f in enumerate(feats)]).collect()
        for r in means:  # one row per cluster
            centres[r["_c"]] = [r[f"m{j}"] for j in range(len(feats))]
    dists = F.array(*[sum(((F.col(f) - F.lit(float(c[j]))) ** 2 for j, f in enumerate(feats)), F.lit(0.0)) for c in centres])
    return assign(data, feats, centres, "cluster").select(id_col, "cluster", F.array_min(dists).alias("cost"))


def label_all(data: DataFrame, feats: list[str], best: dict, id_col: str = "customer_id") -> DataFrame:
    """``label_k{k}`` for every k in one pass; clusters renumbered by
    descending size, then smallest member id (stable names).  The size
    table has sum(k) rows, so the renumbering is applied as literal maps."""
    centres = {k: m["centres"] for k, m in best.items()}
    kept = data.select(id_col, *[F.col(f).cast("double").alias(f) for f in feats]).dropna(subset=feats)

    def label(it):
        for pdf in it:
            x = pdf[feats].to_numpy(dtype=float)
            for k, c in centres.items():
                pdf[f"_raw{k}"] = squared_distances(x, c).argmin(1).astype("int32") if len(x) else pd.Series([], dtype="int32")
            yield pdf

    kinds = ", ".join([f"{id_col} {kept.schema[id_col].dataType.simpleString()}", *[f"{f} double" for f in feats],
                       *[f"_raw{k} int" for k in best]])
    raw = kept.mapInPandas(label, kinds).transform(cut)
    rows = (raw.select(id_col, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_raw{k}").alias("raw")) for k in best])).alias("r"))
            .groupBy("r.k", "r.raw").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first")).collect())
    maps = {}
    for k in best:
        ordered = sorted((r for r in rows if r["k"] == k), key=lambda r: (-r["n"], r["first"]))
        maps[k] = F.create_map(*[F.lit(x) for i, r in enumerate(ordered) for x in (int(r["raw"]), i)])
    return raw.select(id_col, *feats, *[maps[k][F.col(f"_raw{k}")].cast("int").alias(f"label_k{k}") for k in best])


def fit_best(data: DataFrame, k: int, n_init: int = 10, seed: int = SEED, feats: list[str] | None = None):
    """F8 for one k: best of ``n_init`` restarts.  Returns (inertia, seed, centres)."""
    feats = feats or [c for c in data.columns if c != "customer_id"]
    b = best_per_k(kmeans_batch(data, feats, [k], n_init, seed))[k]
    return b["inertia"], b["seed"], b["centres"]


def silhouette(points: DataFrame, feats: list[str], label_cols: dict, id_col: str = "customer_id", cells: int | None = None) -> DataFrame:
    """mean Euclidean silhouette per labeling ``{k: label column}``, with a proven bound: k, silhouette, bound.

    Exact over all pairs of customers (bound 0), in blocks, unless ``cells`` asks for an estimate:
    a median split cuts the space into at most ``cells`` cells; of every cluster's
    part of a cell the number, the mean c and the mean squared distance v to
    it are kept.  The mean distance of x to these points is at least |x - c|
    and at most sqrt(|x - c|^2 + v) (Jensen, both ways), so every mean distance, and
    with it every silhouette, lies in an interval; the result is the middle, the bound half of
    the width, on average.  With as many cells as customers v is 0 and the result exact.
    Work: customers x cells, one pass; the summaries are broadcast.
    A point alone in its cluster scores 0.  Rows with a null feature or label are left out.
    """
    ks = sorted(label_cols)
    names = [f"l{k}" for k in ks]
    rows = points.dropna(subset=[*feats, *label_cols.values()]).select(
        *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(feats)], *[F.col(label_cols[k]).cast("int").alias(n) for k, n in zip(ks, names)],
        F.col(id_col).cast("string").alias("id")).transform(cut)
    xs = [f"x{j}" for j in range(len(feats))]
    if cells is None:
        return _pair_silhouette(rows, xs, ks, names)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SPLIT_SAMPLE).select(*xs).toPandas().to_numpy(dtype=float)
    tree = median_tree(sample, cells)

    def deal(it):
        for pdf in it:
            if len(pdf):
                x = pdf[xs].to_numpy()
                at, leaf, own = leaves_of(tree, x, x, 0.0)
                first = np.zeros(len(pdf), np.int64)
                first[at[own]] = leaf[own]
                for k, n in zip(ks, names):
                    yield pd.DataFrame({"k": k, "label": pdf[n], "leaf": first, **{c: pdf[c] for c in xs}})

    # means first, distances from them afterwards: sums of squares would lose the small ones
    kind = "k int, label int, leaf bigint, " + ", ".join(f"{c} double" for c in xs)
    dealt = rows.mapInPandas(deal, kind).transform(cut)
    means = dealt.groupBy("k", "label", "leaf").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in xs])
    spread = dealt.join(F.broadcast(means), ["k", "label", "leaf"]).groupBy("k", "label", "leaf").agg(
        F.first("n").alias("n"), *[F.first(f"m{c}").alias(f"m{c}") for c in xs],
        F.avg(sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in xs), F.lit(0.0))).alias("v")).toPandas()  # cells x labelings at most
    tables = {}
    for k in ks:
        t = spread[spread["k"] == k]
        labels = np.sort(t["label"].unique())
        own = np.searchsorted(labels, t["label"])
        weight = np.zeros((len(t), len(labels)))
        weight[np.arange(len(t)), own] = t["n"]
        tables[k] = (labels, weight, weight.sum(0), t[[f"m{c}" for c in xs]].to_numpy(), t["v"].to_numpy())

    def score(it):
        for pdf in it:
            out = []
            for k, n in zip(ks, names):
                labels, weight, size, mid, v = tables[k]
                for part in range(0, len(pdf), 256):
                    x = pdf[xs].iloc[part:part + 256].to_numpy()
                    at = np.searchsorted(labels, pdf[n].iloc[part:part + 256].to_numpy())
                    d2 = sum((x[:, j][:, None] - mid[:, j][None, :]) ** 2 for j in range(len(xs)))
                    low, high = np.sqrt(d2) @ weight, np.sqrt(d2 + v) @ weight
                    here, alone = np.arange(len(x)), size[at] < 2
                    a_low, a_high = (t[here, at] / np.maximum(size[at] - 1, 1) for t in (low, high))
                    low, high = low / size, high / size
                    low[here, at] = high[here, at] = np.inf
                    b_low, b_high = low.min(1), high.min(1)
                    ok = ~alone & np.isfinite(b_low)

                    def s(a, b):
                        b = np.where(ok, b, 0.0)
                        return np.where(ok & (np.maximum(a, b) > 0), (b - a) / np.where(np.maximum(a, b) > 0, np.maximum(a, b), 1.0), 0.0)

                    worst, best = s(a_high, b_low), s(a_low, b_high)
                    out.append((k, float(worst.sum()), float(best.sum()), len(x)))
            yield pd.DataFrame(out, columns=["k", "low", "high", "n"])

    mean = lambda c: F.sum(c) / F.sum("n")
    return rows.mapInPandas(score, "k int, low double, high double, n bigint").groupBy("k").agg(
        ((mean("low") + mean("high")) / 2).alias("silhouette"), ((mean("high") - mean("low")) / 2).alias("bound"))


def _pair_silhouette(rows: DataFrame, xs: list[str], ks: list[int], names: list[str]) -> DataFrame:
    """(k, silhouette, bound 0) from all pairs of ``rows``; equal customers are merged first."""
    points = rows.groupBy(*xs, *names).agg(F.count(F.lit(1)).alias("w")).transform(cut)
    sizes = [{r[0]: r[1] for r in points.groupBy(n).agg(F.sum("w")).collect()} for n in names]  # one row a label
    values = [sorted(s) for s in sizes]
    if not values or not values[0]:
        return rows.select(F.lit(0).alias("k"), F.lit(0.0).alias("silhouette"), F.lit(0.0).alias("bound")).limit(0)
    first = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(int)

    def score(it):
        for pdf in it:
            out = []
            for t, (k, n) in enumerate(zip(ks, names)):
                sums, size = pdf[[f"s{p}" for p in range(first[t], first[t + 1])]].to_numpy(), np.array([sizes[t][v] for v in values[t]], float)
                own, here, w = np.searchsorted(values[t], pdf[n].to_numpy()), np.arange(len(pdf)), pdf["w"].to_numpy()
                a = sums[here, own] / np.maximum(size[own] - 1, 1)
                others = sums / size
                others[here, own] = np.inf
                b = others.min(1)
                ok = (size[own] > 1) & np.isfinite(b)
                b = np.where(ok, b, 0.0)
                top = np.maximum(a, b)
                s = np.where(ok & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
                out.append((k, float((s * w).sum()), int(w.sum())))
            yield pd.DataFrame(out, columns=["k", "s", "n"])

    return distance_sums(points, points.count(), xs, names, values).mapInPandas(score, "k int, s double, n bigint").groupBy("k").agg(
        (F.sum("s") / F.sum("n")).alias("silhouette"), F.lit(0.0).alias("bound"))


def evaluate_k_range(feats_df: DataFrame, feats: list[str], k_min: int = 2, k_max: int = 10,
                     n_init: int = 10, seed: int = SEED):
    """F13 (+F14): fit every k (all restarts batched) and score it.

    k is chosen by the squared-distance silhouette, whose cost is linear in
    the customers and whose result needs no bound.

    Returns (scores DataFrame with k, wcss, silhouette, davies_bouldin,
    calinski_harabasz, combined; labelled DataFrame with ``label_k{k}``;
    {k: best restart}).
    """
    data = feats_df.select("customer_id", *[F.col(c).cast("double").alias(c) for c in feats]).transform(cut)
    best = best_per_k(kmeans_batch(data, feats, list(range(k_min, k_max + 1)), n_init, seed))
    labelled = label_all(data, feats, dict(sorted(best.items())))
    label_cols = {k: f"label_k{k}" for k in best}
    metrics = label_metrics(labelled, feats, label_cols)
    sil = squared_silhouette(labelled, feats, label_cols)
    scores = combined_score(metrics.join(sil, "k"))
    return (scores.select("k", "wcss", "silhouette", "davies_bouldin", "calinski_harabasz", "combined"),
            labelled, best)


def cluster_segments(feats_df: DataFrame, feats: list[str], k_min: int = 2, k_max: int = 10,
                     method: str = "combined", k_override: int | None = None, n_init: int = 10):
    """F23 core: choose k (or take ``k_override`` inside the range), label
    ``Cluster i``.  Returns (customer_id + segment DataFrame, scores, k); the
    scores say for every k in how many iterations its best restart ended, and
    whether it converged."""
    scores, labelled, best = evaluate_k_range(feats_df, feats, k_min, k_max, n_init)
    fits = feats_df.sparkSession.createDataFrame([(k, m["iterations"], m["converged"]) for k, m in best.items()],
                                                 "k int, iterations int, converged boolean")
    scores = scores.join(F.broadcast(fits), "k", "left").transform(cut)  # one row per k
    if k_override is not None and k_min <= k_override <= k_max:
        k = k_override
    else:
        k = int(select_k(scores, method).collect()[0][0])
    seg = labelled.select("customer_id", F.concat(F.lit("Cluster "), F.col(f"label_k{k}").cast("string")).alias("segment"))
    return seg, scores, k


def pca2(df: DataFrame, feats: list[str]) -> DataFrame:
    """first two principal components of the centred features.

    An axis may point either way; here the loading of largest magnitude is positive.
    """
    mu = df.agg(*[F.avg(c).alias(c) for c in feats]).first()
    centred = df.select("customer_id", *[(F.col(c) - F.lit(mu[c])).alias(c) for c in feats])
    data = assemble(centred, feats)
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(data)
    out = model.transform(data).select("customer_id", vector_to_array("_pc").alias("_pc"))
    axes = model.pc.toArray()  # features x 2
    way = [1.0 if axis[np.argmax(np.abs(axis))] >= 0 else -1.0 for axis in axes.T]
    ev = [float(v) for v in model.explainedVariance]
    return out.select("customer_id", (F.col("_pc")[0] * way[0]).alias("pc1"), (F.col("_pc")[1] * way[1]).alias("pc2"),
                      F.lit(ev[0]).alias("explained_1"), F.lit(ev[1]).alias("explained_2"))
