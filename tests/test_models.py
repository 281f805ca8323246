"""NumPy cross-checks for the iterative / n^2 operators (no sklearn here)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import kmeans as K
from cohortkit.operators.dbscan import dbscan
from tests.conftest import SF001

RFM3 = ["Recency", "Frequency", "Monetary"]


@pytest.fixture(scope="module")
def scaled(spark):
    from cohortkit.plans.q_clusters import scaled as sc
    return sc(spark, SF001).orderBy("customer_id").cache()


def np_dbscan(x, eps, min_samples):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= min_samples
    lab = -np.ones(n, int)
    c = 0
    for i in range(n):  # sklearn order: clusters grow from cores in row order
        if not core[i] or lab[i] >= 0:
            continue
        stack = [i]
        lab[i] = c
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in np.nonzero(nb[p])[0]:
                if lab[q] < 0:
                    lab[q] = c
                    stack.append(q)
        c += 1
    return lab, core


@pytest.mark.parametrize("eps,ms", [(0.5, 5), (0.3, 3)])
def test_dbscan_matches_numpy(spark, scaled, eps, ms):
    pdf = scaled.toPandas()
    lab, core = np_dbscan(pdf[RFM3].to_numpy(), eps, ms)
    got = {r.customer_id: (r.segment, r.is_core) for r in dbscan(scaled, RFM3, eps, ms).collect()}
    ids = pdf["customer_id"].tolist()
    assert [got[i][1] for i in ids] == list(core)
    # partitions equal up to border ties: compare core labels exactly
    exp = [f"Cluster {v}" if v >= 0 else "Noise" for v in lab]
    assert [got[i][0] for i, c in zip(ids, core) if c] == [e for e, c in zip(exp, core) if c]
    assert sum(1 for i in ids if got[i][0] == "Noise") == int((lab < 0).sum())


def np_silhouette(x, lab):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    s = np.zeros(len(x))
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() <= 1:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s[i] = (b - a) / max(a, b)
    return s.mean()


def test_silhouette_matches_numpy(spark, scaled):
    lab = scaled.withColumn("l3", (F.col("customer_id").cast("long") % 3).cast("int"))
    pdf = lab.toPandas()
    want = np_silhouette(pdf[RFM3].to_numpy(), pdf["l3"].to_numpy())
    exact = K.silhouette(lab, RFM3, {3: "l3"}).first()
    assert exact.silhouette == pytest.approx(want, abs=1e-9) and exact.bound < 1e-9
    for cells in (8, 40):
        rough = K.silhouette(lab, RFM3, {3: "l3"}, cells=cells).first()
        assert abs(rough.silhouette - want) <= rough.bound and rough.bound < (0.4 if cells == 8 else 0.15)


def np_dtw(a, b):
    la, lb = len(a), len(b)
    D = np.full((la + 1, lb + 1), np.inf)
    D[0, 0] = 0
    for i in range(1, la + 1):
        for j in range(1, lb + 1):
            c = ((a[i - 1] - b[j - 1]) ** 2).sum()
            D[i, j] = c + min(D[i - 1, j], D[i, j - 1], D[i - 1, j - 1])
    return np.sqrt(D[la, lb])


def np_lloyd(x, k, seed, iters=300):
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(iters):
        lab = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return ((x - c[lab]) ** 2).sum()


def test_kmeans_wcss_close_to_numpy_best(spark, scaled):
    data = scaled.select("customer_id", *RFM3)
    inertia, _seed, _c = K.fit_best(data, 4, n_init=10, feats=RFM3)
    x = scaled.toPandas()[RFM3].to_numpy()
    best = min(np_lloyd(x, 4, s) for s in range(20))
    assert inertia <= best * 1.01


def test_axes_point_along_their_largest_loading(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) @ np.array([[3.0, 0, 0], [-2.0, 1.0, 0], [0.5, 0, 0.2]])
    df = spark.createDataFrame([(str(i), *map(float, r)) for i, r in enumerate(x)], "customer_id string, a double, b double, c double")
    got = {int(r.customer_id): (r.pc1, r.pc2) for r in K.pca2(df, ["a", "b", "c"]).collect()}
    centred = x - x.mean(0)
    axes = np.linalg.svd(centred)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    assert np.allclose([got[i] for i in range(200)], centred @ axes.T)
