"""Density peaks, DBSCAN and the K-Means coreset against NumPy."""

import numpy as np
import pytest

from cohortkit.operators import boxes as B
from cohortkit.operators import kmeans as K
from cohortkit.operators import peaks as PK
from cohortkit.operators.dbscan import dbscan, eps_neighbour_counts
from tests.test_models import np_dbscan


def frame(spark, x):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(f"c{i:05d}", *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "customer_id string, " + ", ".join(f"{n} double" for n in names)), names


def blobs(dims, seed=0):
    r = np.random.default_rng(seed)
    x = [r.normal(0, .25, (300, dims)), r.normal(1.2, .3, (200, dims)), r.uniform(-4, 4, (80, dims)), np.tile(r.normal(0, 1, dims), (30, 1))]
    return np.round(np.concatenate(x), 3)


@pytest.mark.parametrize("dims,eps,ms", [(2, .3, 5), (3, .5, 6), (8, .9, 5)])
def test_dbscan_and_counts(spark, dims, eps, ms, monkeypatch):
    monkeypatch.setattr(B, "LEAF_CELLS", 40)
    x = blobs(dims)
    df, feats = frame(spark, x)
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    n = {f"c{i:05d}": int(v) for i, v in enumerate((d2 <= eps * eps).sum(1))}
    assert {r.customer_id: r.n_eps for r in eps_neighbour_counts(df, feats, eps, few=16).collect()} == n
    lab, core = np_dbscan(x, eps, ms)
    got = {r.customer_id: (r.segment, r.is_core) for r in dbscan(df, feats, eps, ms, few=16).collect()}
    for i in range(len(x)):
        segment, is_core = got[f"c{i:05d}"]
        assert is_core == core[i] and (segment == "Noise") == (lab[i] < 0)
        assert not core[i] or segment == f"Cluster {lab[i]}"


def test_two_dense_touching_cells_meet_as_boxes(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.uniform(0, .35, (4000, 2)), r.uniform(0, .35, (4000, 2)) + [.36, 0]])
    df, feats = frame(spark, x)
    assert {r.segment for r in dbscan(df, feats, .5, 5).collect()} == {"Cluster 0"}
    apart, _ = frame(spark, np.concatenate([x[:4000], x[4000:] + [.6, 0]]))
    assert {r.segment for r in dbscan(apart, feats, .5, 5).collect()} == {"Cluster 0", "Cluster 1"}


def test_touching_dense_cells_are_not_refined(spark, monkeypatch):
    df, feats = frame(spark, np.random.default_rng(5).uniform(0, 2, (4000, 2)))
    refine, asked = B.refine, []
    monkeypatch.setattr(B, "refine", lambda points, pairs, *a, **k: asked.append(pairs.count()) or refine(points, pairs, *a, **k))
    assert {r.segment for r in dbscan(df, feats, .5, 5).collect()} == {"Cluster 0"} and asked == [0]


@pytest.mark.parametrize("middle,clusters", [(.349, 1), (.347, 2)])
def test_dense_cells_that_touch_by_inner_points(spark, middle, clusters):
    corners = [[a, b] for a in (.0, .01, .35) for b in (0, .35)]  # outermost, and beyond eps from the other cell
    x = np.array(corners + [[middle, .175]] + [[.848 + .01 * i, .175] for i in range(6)])
    df, feats = frame(spark, x)
    lab, core = np_dbscan(x, .5, 5)
    assert core.all() and len(set(lab)) == clusters
    assert [r.segment for r in dbscan(df, feats, .5, 5).orderBy("customer_id").collect()] == [f"Cluster {i}" for i in lab]


@pytest.mark.parametrize("count", [True, False])
def test_refine_reads_the_points_of_undecided_boxes_only(spark, count, monkeypatch):
    r = np.random.default_rng(6)
    x = np.concatenate([r.uniform(0, .5, 100), r.uniform(.5, 1, 100), r.uniform(20, 20.5, 1000)])
    points = spark.createDataFrame([(f"c{i:05d}", 1, [float(v)]) for i, v in enumerate(x)], "_pid string, _w long, _x array<double>")
    pairs = spark.createDataFrame([([0], [1])], "u array<bigint>, v array<bigint>")
    boxes, seen = B.boxes, []
    monkeypatch.setattr(B, "boxes", lambda points, *a: seen.append(points.count()) or boxes(points, *a))
    got = B.refine(points, pairs, 1, .5, .5, count, few=16).collect()
    assert max(seen) == 200
    if count:
        n = (abs(x[:100, None] - x[None, 100:200]) <= .5).sum(1)
        assert {g["_pid"]: g["add"] for g in got} == {f"c{i:05d}": int(v) for i, v in enumerate(n) if v}
    else:
        assert [(g.u, g.v) for g in got] == [([0], [1])]


def test_dbscan_works_its_input_out_once(spark):
    from cohortkit.plans.q_clusters import scaled
    from tests.conftest import SF001
    df, feats = frame(spark, blobs(3))
    seen = spark.sparkContext.accumulator(0)

    def through(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf

    assert dbscan(df.mapInPandas(through, df.schema), feats, .5, 5).count() == df.count() == seen.value
    assert "FileScan" not in scaled(spark, SF001)._jdf.queryExecution().executedPlan().toString()


def test_dbscan_is_the_same_with_cells_sent_or_exchanged(spark, monkeypatch):
    from cohortkit.operators import dbscan as DB
    df, feats = frame(spark, blobs(3))
    found = []
    for most in (DB.BROADCAST_CELLS, 0):
        monkeypatch.setattr(DB, "BROADCAST_CELLS", most)
        found.append(sorted(dbscan(df, feats, .5, 6, few=16).collect()))
    assert found[0] == found[1]


def test_median_tree_deals_evenly_and_reaches_every_neighbour():
    r = np.random.default_rng(2)
    x = r.normal(size=(5000, 4)) ** 3
    rows, leaf, own = B.leaves_of(B.median_tree(x, 16), x, x, .05)
    assert sorted(rows[own]) == list(range(5000)) and np.bincount(leaf[own]).max() < 2 * 5000 / 16
    home = dict(zip(rows[own].tolist(), leaf[own].tolist()))
    there = set(zip(rows.tolist(), leaf.tolist()))
    for i in range(0, 5000, 50):
        assert all((j, home[i]) in there for j in np.flatnonzero((abs(x - x[i]) <= .05).all(1)).tolist())


def np_peaks(x, ids, dc):
    cells = {}
    for i, g in enumerate(map(tuple, np.floor(x / dc).astype(int))):
        cells.setdefault(g, []).append(i)
    first = [min(ids[i] for i in m) for m in cells.values()]
    c = np.array([x[m].mean(0) for m in cells.values()])
    n = np.array([len(m) for m in cells.values()])
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
    rho = np.round((np.where(d <= 3 * dc, np.exp(-(d / dc) ** 2), 0) * n).sum(1), 6)
    delta = {}
    for i in range(len(c)):
        up = [d[i, j] for j in range(len(c)) if (rho[j], ) > (rho[i],) or (rho[j] == rho[i] and first[j] < first[i])]
        delta[i] = min(up) if up else None
    top = max([v for v in delta.values() if v is not None], default=0.0)
    out = {}
    for i, m in enumerate(cells.values()):
        for p in m:
            out[ids[p]] = (rho[i], (top if delta[i] is None else delta[i]) if ids[p] == first[i] else 0.0)
    return out


@pytest.mark.parametrize("dims", [1, 3, 5])
def test_density_peaks(spark, dims, monkeypatch):
    x = blobs(dims, 3)
    df, feats = frame(spark, x)
    want = np_peaks(x, [f"c{i:05d}" for i in range(len(x))], .4)
    for few in (PK.BROADCAST_CELLS, 0):
        monkeypatch.setattr(PK, "BROADCAST_CELLS", few)
        got = {r.id: (r.rho, r.delta) for r in PK.density_peaks(df, feats, 4, .4).collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)


def test_peaks_of_equal_and_missing_customers(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("c", None, 1.0)], "customer_id string, x double, y double")
    got = {r.id: (r.rho, r.delta, r.center_rank) for r in PK.density_peaks(df, ["x", "y"], 1).collect()}
    assert got == {"a": (2.0, 0.0, 1), "b": (2.0, 0.0, None)}
    assert PK.density_peaks(df.limit(0), ["x", "y"], 1).count() == 0


def test_coreset(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(m, .5, (6000, 3)) for m in (0, 3, 7)] + [r.normal(40, 1, (12, 3))])
    df, feats = frame(spark, x)
    px, w = K.coreset(df, feats, size=2000)
    assert 1700 < len(px) < 2300 and w.sum() == pytest.approx(len(x), rel=.1)
    whole, ones = K.coreset(df, feats, size=2 * len(x))
    assert len(whole) == len(x) and set(ones) == {1.0}
    assert K.coreset(df.limit(0), feats)[0].shape == (0, 3)
    loss = lambda c: K.squared_distances(x, c).min(1).sum()
    full = K.best_per_k(K.kmeans_batch(df, feats, [4], 6))[4]
    small = K.best_per_k(K.kmeans_batch(df, feats, [4], 6, size=2000))[4]
    assert full["inertia"] == pytest.approx(loss(full["centres"]))
    assert loss(small["centres"]) <= 1.05 * loss(full["centres"])


def test_rfm_totals_are_worked_out_once(spark):
    from cohortkit.operators import orders as A
    df = spark.sql("SELECT CAST(id % 7 AS STRING) customer_id, CAST(id AS STRING) order_id, TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(id) order_date, "
                   "CAST(id AS DOUBLE) order_total FROM range(50)")
    seen = spark.sparkContext.accumulator(0)

    def through(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf

    got = A.rfm(df.mapInPandas(through, df.schema), once=True)
    assert sorted(got.collect()) == sorted(got.collect()) == sorted(A.rfm(df).collect()) and seen.value == 50
