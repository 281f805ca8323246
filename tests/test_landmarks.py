"""Landmark distances, warping with bounds and the Nystroem embedding against direct NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import landmarks as LM
from tests.test_models import np_dtw


def walks(n, seed=0):
    r = np.random.default_rng(seed)
    return [np.cumsum(r.normal(size=(r.integers(1, 14), 2)), 0) for _ in range(n)]


def test_warping_bounds_and_limits():
    x, y = walks(12, 1), walks(5, 2)
    d = np.array([[np_dtw(a, b) ** 2 for b in y] for a in x])
    assert (LM.warp_bounds(x, y) <= d + 1e-9).all()
    i, j = np.indices(d.shape)
    pairs = [x[a] for a in i.ravel()], [y[b] for b in j.ravel()]
    assert LM.warp_pairs(*pairs, np.full(d.size, np.inf)) == pytest.approx(d.ravel())
    limit = d.ravel() * np.where(np.arange(d.size) % 2, 1.01, 0.99)
    got = LM.warp_pairs(*pairs, limit)
    assert got[1::2] == pytest.approx(d.ravel()[1::2]) and np.isinf(got[::2]).all()


def test_nearest_by_warping(spark):
    x = walks(80, 3)
    df = spark.createDataFrame([(f"c{i:03d}", s.tolist()) for i, s in enumerate(x)], "id string, series array<array<double>>")
    marks = LM.choose(df, 9)
    rows = LM.nearest_by_dtw(df, marks).collect()
    y = [np.array(s.tolist() if hasattr(s, "tolist") else s) for s in (np.stack(v) for v in marks["series"])]
    tried = 0
    for r in rows:
        d = [np_dtw(x[int(r.id[1:])], b) for b in y]
        assert r.dist == pytest.approx(min(d)) and d[marks["id"].tolist().index(r.landmark)] == pytest.approx(min(d))
        tried += r.tried
    assert len(rows) == 80 and tried < 0.7 * 80 * 9
    got = {r.id: r.d for r in LM.dtw_distances(df, marks).collect()}
    assert got["c007"] == pytest.approx([np_dtw(x[7], b) for b in y])
    peaks = LM.landmark_peaks(LM.dtw_distances(df, marks), marks, 3)
    assert len(set(peaks)) == 3
    f = LM.memberships(LM.dtw_distances(df, marks), peaks).first().f
    assert len(f) == 3 and sum(f) == pytest.approx(1.0)


def test_landmark_distances(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 6))
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, x array<double>")
    marks = LM.choose(df, 7)
    for complexity in (False, True):
        for row in LM.landmark_distances(df, marks, complexity=complexity).collect():
            a, b = x[int(row.i)], x[int(row.j)]
            want = np.sqrt(((a - b) ** 2).sum())
            if complexity:
                ca, cb = (np.sqrt((np.diff(v) ** 2).sum()) for v in (a, b))
                want *= max(ca, cb) / (min(ca, cb) + 1e-9)
            assert row.dist == pytest.approx(want, abs=1e-6)


def rand_index(a, b):
    """Adjusted Rand index."""
    t = pd.crosstab(pd.Series(a), pd.Series(b)).to_numpy()
    pairs = lambda v: (v * (v - 1) / 2).sum()
    i, x, y, n = pairs(t), pairs(t.sum(1)), pairs(t.sum(0)), len(a) * (len(a) - 1) / 2
    return (i - x * y / n) / ((x + y) / 2 - x * y / n)


def test_spectral_embedding_agrees_with_the_exact_one(spark):
    from cohortkit.operators import kmeans as K
    r = np.random.default_rng(6)
    f = np.concatenate([r.dirichlet(a, 150) for a in ([9, 1, 1, 1], [1, 9, 1, 1], [1, 1, 9, 1], [1, 1, 1, 9])])
    df = spark.createDataFrame([(f"c{i:04d}", v.tolist()) for i, v in enumerate(f)], "id string, f array<double>")
    got = {x.id: x.u for x in LM.spectral_embedding(df, 4, sigma=.3).collect()}
    u = np.array([got[f"c{i:04d}"] for i in range(len(f))])
    s = np.exp(-((f[:, None] - f[None]) ** 2).sum(-1) / (2 * .3 ** 2))
    d = 1 / np.sqrt(s.sum(1))
    w = np.linalg.eigh(s * d[:, None] * d[None])[1][:, -4:]
    w = w / np.linalg.norm(w, axis=1)[:, None]
    label = lambda x: K.squared_distances(x, min((K.lloyd(x, np.ones(len(x)), K._kmeanspp(x, np.ones(len(x)), 4, np.random.default_rng(t)), 1e-9)
                                                  for t in range(10)), key=lambda m: m[1])[0]).argmin(1)
    assert rand_index(label(u), label(w)) > 0.95
    assert LM.spectral_embedding(df.limit(0), 4).count() == 0 and df.agg(F.count("id")).first()[0] == len(f)


def test_a_warping_steps_by_diagonals_not_by_cells():
    import sys
    r = np.random.default_rng(4)
    x, y, lines = [r.random((n, 3)) for n in (60, 55, 60)], [r.random((n, 3)) for n in (50, 62, 50)], []

    def count(frame, event, _arg):
        if frame.f_code.co_filename == LM.__file__:
            lines.append(event)
            return count

    sys.settrace(count)
    try:
        got = LM.warp_pairs(x, y, np.full(3, np.inf))
    finally:
        sys.settrace(None)
    assert np.sqrt(got) == pytest.approx([np_dtw(a, b) for a, b in zip(x, y)]) and len(lines) < 60 * (60 + 62)


def test_warpings_over_several_batches_and_lengths(spark):
    x = walks(1100, 7)
    df = spark.createDataFrame([(f"c{i:04d}", s.tolist()) for i, s in enumerate(x)], "id string, series array<array<double>>").coalesce(1)
    marks = LM.choose(df, 4)
    y = [np.stack(v) for v in marks["series"]]
    d = {r.id: r.d for r in LM.dtw_distances(df, marks).collect()}
    near = {r.id: r for r in LM.nearest_by_dtw(df, marks).collect()}
    assert len(d) == len(near) == 1100
    for i in range(0, 1100, 7):
        want = [np_dtw(x[i], b) for b in y]
        assert d[f"c{i:04d}"] == pytest.approx(want) and near[f"c{i:04d}"].dist == pytest.approx(min(want))
    assert LM.dtw_distances(df.limit(0), marks).count() == 0


def test_series_are_filled_and_packed_without_exchanging_the_spine(spark):
    from cohortkit.operators import series as T
    rows = [("a", "1996-01-05", "1", 5.0), ("a", "1996-01-20", "2", 6.0), ("a", "1996-04-02", "3", 7.0), ("b", "1996-03-31", "4", 1.0)]
    o = spark.createDataFrame(rows, "customer_id string, d string, order_id string, order_total double").withColumn(
        "order_date", F.col("d").cast("timestamp_ntz"))
    m = T.monthly_lrfm(o).localCheckpoint()
    filled = T.fill_series(T.month_spine(m), m)
    got = [(r.customer_id, r.month.month, r.L, r.R_prime, r.F, r.M) for r in filled.orderBy("customer_id", "month").collect()]
    assert got == [("a", 1, 15.0, 11.0, 2.0, 11.0), ("a", 2, 0.0, 40.0, 0.0, 0.0), ("a", 3, 0.0, 71.0, 0.0, 0.0), ("a", 4, 0.0, 28.0, 1.0, 7.0),
                   ("b", 3, 0.0, 0.0, 1.0, 1.0), ("b", 4, 0.0, 30.0, 0.0, 0.0)]
    assert "hashpartitioning(customer_id" in (plan := filled._jdf.queryExecution().executedPlan().toString())
    assert not [line for line in plan.splitlines() if "hashpartitioning(" in line and "month" in line.split("hashpartitioning(")[1].split("]")[0]]
    packed = T.pack_series(filled, "month", ["L", "F", "M"])
    back = [(r.customer_id, r.month, r.M) for r in T.unpack_series(packed, "month", {"M": 2}).orderBy("customer_id", "month").collect()]
    assert back == [("a", 0, 11.0), ("a", 1, 0.0), ("a", 2, 0.0), ("a", 3, 7.0), ("b", 0, 1.0), ("b", 1, 0.0)]


def test_orders_of_the_monthly_series_are_read_once(spark):
    from cohortkit.plans.q_clusters import monthly_series
    from tests.conftest import SF001
    assert "FileScan" not in monthly_series(spark, SF001)._jdf.queryExecution().executedPlan().toString()
