"""Cases the fixtures of the named queries cannot show."""

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import clean, cluster_metrics, scaling, series
from cohortkit.operators.components import connected_components
from cohortkit.operators.dbscan import dbscan
from cohortkit.plans.flows import prepare_orders
from cohortkit.sources import io

MAPPING = {"customer_id": "c", "order_id": "o", "order_date": "d", "order_total": "t"}


def test_two_products_of_one_price_stay_two_sales(spark):
    raw = spark.createDataFrame([("a", "1", "2024-01-01", 5.0, "x"), ("a", "1", "2024-01-01", 5.0, "y"),
                                 ("a", "1", "2024-01-01", 5.0, "y")], "c string, o string, d string, t double, product string")
    assert prepare_orders(raw, MAPPING).first().order_total == 10.0
    stats = clean.clean_stats_raw(raw, MAPPING).first()
    assert (stats.rows_before, stats.rows_after, stats.removed_duplicates) == (3, 2, 1)


def test_dbscan_follows_a_long_chain_and_keeps_nulls(spark):
    rows = [(str(i), 0.45 * i, 0.0) for i in range(260)] + [("far", 900.0, 0.0), ("null", None, 0.0)]
    out = {r.customer_id: r.segment for r in dbscan(spark.createDataFrame(rows, "customer_id string, x double, y double"),
                                                    ["x", "y"], 0.5, 3).collect()}
    assert len(out) == 262 and out["far"] == out["null"] == "Noise"
    assert {out[str(i)] for i in range(260)} == {"Cluster 0"}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 99)] + [(200, i) for i in range(201, 260)] + [(300, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(100)} | {i: 200 for i in range(200, 260)} | {300: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_constant_columns_one_row_and_one_cluster(spark):
    df = spark.createDataFrame([("a", 3.0, 1.0), ("b", 3.0, 2.0)], "customer_id string, x double, y double")
    assert [r.x for r in series.minmax_scale(df, ["x"]).collect()] == [None, None]
    w = scaling.deviation_weights(df.select("x"), ["x"]).first()
    assert w.w_x == 1.0
    one = df.withColumn("label", F.lit(0))
    m = cluster_metrics.label_metrics(one, ["x", "y"], {1: "label"}).first()
    assert m.calinski_harabasz == 0.0
    assert cluster_metrics.squared_silhouette(one, ["x", "y"], {1: "label"}).first().silhouette == 0.0


def test_elbow_may_start_at_one(spark):
    scores = spark.createDataFrame([(1, 100.0), (2, 20.0), (3, 18.0), (4, 17.0)], "k int, wcss double")
    assert cluster_metrics.select_k(scores, "elbow", k_start=1).first().k == 2


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, None)], "a int, b double")
    assert [r.b for r in io.preview(df).collect()] == ["", ""]
    df.limit(0).createOrReplaceTempView("empty_table")
    with pytest.raises(ValueError):
        io.read_table(spark, "empty_table")
    from datetime import datetime
    path = str(tmp_path / "history")
    io.append_history(df, path, io.run_meta("m", {}, "r1", datetime(2024, 1, 1, 5)))
    io.append_history(df.withColumn("extra", F.lit(7)), path, io.run_meta("m", {}, "r2", datetime(2024, 1, 2, 5)))
    rows = io.create_latest_view(spark, path, "latest_result").collect()
    assert {r.run_id for r in rows} == {"r2"} and {r.extra for r in rows} == {7}
    # the newest run's folder is all that is listed
    assert all("run_date=2024-01-02/run=rr2" in f for f in io.latest_run(spark, path).inputFiles())
    # a write that is tried again adds nothing; one that was cut off before its line in the log is replaced
    io.append_history(df, path, io.run_meta("m", {}, "r2", datetime(2024, 1, 2, 5)))
    assert io.read_history(spark, path).count() == 4
    df.write.mode("append").parquet(f"{path}/run_date=2024-01-03/run=r7")
    io.append_history(df, path, io.run_meta("m", {}, "7", datetime(2024, 1, 3)))
    assert io.read_history(spark, path).count() == 6 and io.latest_run(spark, path).first().run_id == "7"
    assert {r.run_id for r in spark.table("latest_result").collect()} == {"r2"}
    spark.sql("DROP VIEW latest_result")
    with pytest.raises(ValueError):
        io.latest_run(spark, str(tmp_path / "none"))


def test_latest_view_of_a_table_follows_later_runs(spark):
    from datetime import datetime
    df = spark.createDataFrame([(1,), (2,)], "a int")
    for name in ("runs_of_test", "runs_view_of_test"):
        spark.sql(f"DROP {'VIEW' if 'view' in name else 'TABLE'} IF EXISTS {name}")
    try:
        io.append_history_table(df, "runs_of_test", io.run_meta("m", {}, "r1", datetime(2024, 1, 1, 5)))
        view = io.create_latest_table_view(spark, "runs_of_test", "runs_view_of_test")
        assert {r.run_id for r in view.collect()} == {"r1"}
        for _ in range(2):
            io.append_history_table(df, "runs_of_test", io.run_meta("m", {}, "r2", datetime(2024, 1, 1, 6)))
        assert [r.run_id for r in spark.table("runs_view_of_test").collect()] == ["r2", "r2"]
    finally:
        spark.sql("DROP VIEW IF EXISTS runs_view_of_test")
        spark.sql("DROP TABLE IF EXISTS runs_of_test")


def test_rows_that_share_a_key_stay(spark):
    raw = spark.createDataFrame([("a", "1", "2024-01-01", 5.0, None, "x"), ("a", "1", "2024-01-01", 5.0, "x", None),
                                 ("a", "1", "2024-01-01", 5.0, "x", None)], "c string, o string, d string, t double, p string, q string")
    assert prepare_orders(raw, MAPPING, key=["o"]).first().order_total == 10.0


def test_history_table_takes_new_columns(spark):
    from datetime import datetime
    name = "history_of_runs_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    try:
        io.append_history_table(df, name, io.run_meta("m", {}, "r1", datetime(2024, 1, 1, 5)))
        io.append_history_table(df.withColumn("extra", F.lit(7)), name, io.run_meta("m", {}, "r2", datetime(2024, 1, 2, 5)))
        assert sorted((r.run_id, r.extra) for r in spark.table(name).select("run_id", "extra").collect()) == [("r1", None), ("r2", 7)]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_exact_distincts_without_a_row_per_column(spark):
    from cohortkit.operators import profile
    df = spark.range(30_000).selectExpr("id", "id % 7 AS `a b`", "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 11 AS STRING) END AS s",
                                        "CASE WHEN id % 2 = 0 THEN double('NaN') WHEN id % 5 = 0 THEN -0.0D ELSE 0.0D END AS x", "CAST(NULL AS INT) AS none",
                                        "timestamp_seconds(id % 13) AS t")
    got = {r.column_name: r.distinct_values for r in profile.distinct_counts(df).collect()}
    assert got == {"id": 30_000, "a b": 7, "s": 11, "x": 2, "t": 13}
    report = profile.validation_report(df)
    assert {r.column_name: r.distinct_values for r in report.collect()} == {**got, "none": 0}
    assert "Expand" not in report._jdf.queryExecution().executedPlan().toString()
