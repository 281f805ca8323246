"""All pairs by blocks against direct NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import kmeans as K
from cohortkit.operators import pairs as PR
from cohortkit.plans import q_clusters as Q
from tests.test_models import RFM3, np_silhouette


@pytest.mark.parametrize("distance", [PR.euclid, PR.complexity_invariant])
def test_every_pair_of_vectors_has_its_distance(spark, distance):
    x = np.random.default_rng(5).normal(size=(150, 6)) + 50
    x[7], x[8] = x[3], x[3] + 1e-7
    rows = [(str(i), v.tolist()) for i, v in enumerate(x)] + [("5", x[9].tolist()), (None, x[0].tolist()), ("x", None)]
    df = spark.createDataFrame(rows, "id string, x array<double>")
    got = PR.pair_distances(df, len(rows), distance, block=40).collect()
    names = [r for r in rows if r[0] is not None]
    assert len(got) == sum(a[0] < b[0] for a in names for b in names)
    assert all(r.i < r.j and (r.dist is None) == (r.j == "x") for r in got)
    for r in got:
        if r.j == "x" or "5" in (r.i, r.j):
            continue
        a, b = x[int(r.i)], x[int(r.j)]
        want = np.sqrt(((a - b) ** 2).sum())
        if distance is not PR.euclid:
            ca, cb = (np.sqrt((np.diff(v) ** 2).sum()) for v in (a, b))
            want *= max(ca, cb) / (min(ca, cb) + 1e-9)
        assert r.dist == pytest.approx(want, rel=1e-7, abs=1e-12)


@pytest.mark.parametrize("query", [Q.t17, Q.j9, Q.t19])
def test_queries_on_vectors_return_all_pairs(spark, tmp_path, query):
    x = np.random.default_rng(1).normal(size=(90, 4))  # more than the 64 landmarks
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    got = {(r.i, r.j) for r in query(spark, str(tmp_path)).collect()}
    assert got == {(str(a), str(b)) for a in range(90) for b in range(90) if str(a) < str(b)}


def test_silhouette_is_exact_beyond_2048_customers(spark):
    r = np.random.default_rng(2)
    x, lab = np.round(r.normal(size=(2600, 3)), 2), r.integers(0, 3, 2600)
    x[:40], lab[:40] = x[0], 1  # copies
    df = spark.createDataFrame([(str(i), *map(float, v), int(c), int(c % 2)) for i, (v, c) in enumerate(zip(x, lab))],
                               "customer_id string, Recency double, Frequency double, Monetary double, l3 int, l2 int")
    got = {row.k: row for row in K.silhouette(df, RFM3, {3: "l3", 2: "l2"}).collect()}
    assert got[3].silhouette == pytest.approx(np_silhouette(x, lab), abs=1e-10) and got[3].bound == 0
    assert got[2].silhouette == pytest.approx(np_silhouette(x, lab % 2), abs=1e-10)
    assert K.silhouette(df.limit(0), RFM3, {3: "l3"}).count() == 0


def test_pairs_leave_in_runs_of_their_first_id(spark):
    x = np.random.default_rng(6).normal(size=(1200, 2))
    df = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, x array<double>")
    got = PR.pair_distances(df, 1200).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    got = got.orderBy("row").select("part", "i", "j").toPandas()
    runs = ((got["i"] != got["i"].shift()) | (got["part"] != got["part"].shift())).sum()
    assert len(got) == 1200 * 1199 // 2 and runs < len(got) / 40  # else files hold an id of several bytes a row


def test_a_null_value_leaves_no_distance(spark):
    rows = [("a", [1.0, None]), ("b", [1.0, 2.0]), ("c", [4.0, 6.0])]
    got = PR.pair_distances(spark.createDataFrame(rows, "id string, x array<double>"), 3).collect()
    assert {(r.i, r.j): r.dist for r in got} == {("a", "b"): None, ("a", "c"): None, ("b", "c"): 5.0}
