"""Range-partitioned ordering against DuckDB, NumPy and plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import ordering
from tests.conftest import SF001
from tests.test_oracle import _rows


@pytest.mark.parametrize("name", ["s2_rank_qcut_score", "s9_abc", "s8_rfm_quintile_segments", "h7_pareto_curve",
                                  "h19_boxplot_stats", "f4_winsorize_p99"])
def test_distributed_path_matches_oracle(spark, name):
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from cohortkit.sources.testdata import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = queries()[name](spark, SF001)
    res = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.integers(0, 20, 300).astype(float), rng.random(200) * 50])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(5)
    probs = [0.0, 0.02, 0.2, 0.5, 0.8, 0.99, 1.0]
    exp = np.quantile(vals, probs)
    got = ordering.exact_quantiles(df, "x", probs).first()
    assert [got[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(exp), rel=1e-12, abs=1e-12)


def test_positions_and_prefix_sums(spark):
    df = spark.range(0, 3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("v")).repartition(6)
    pos = ordering.global_positions(df, [F.col("v").asc(), F.col("k").asc()])
    cum = ordering.prefix_sums(df, [F.col("v").desc(), F.col("k").asc()], {"c": F.col("v")})
    rows = [(str(i), i % 7) for i in range(3000)]
    up = {k: i + 1 for i, (k, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.k: r.pos for r in pos.collect()} == up
    total, want = 0, {}
    for i, (k, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        total += v
        want[k] = (total, i + 1)
    assert {r.k: (r.c, r.pos) for r in cum.collect()} == want


def test_no_single_task_window_over_customers(spark):
    from __spark_entry__ import queries
    df = queries()["s2_rank_qcut_score"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # only one-row aggregates and per-partition offsets may meet in one task
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert "partial_" in part.split("\n")[1] or "HashAggregate" in part.split("\n")[1], part[:300]


def test_ranges_follow_the_number_of_rows(spark, monkeypatch):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("v"))
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 100)
    assert ordering._n_parts(df, None) == 50 and ordering._n_parts(df, 3) == 3
    pos = ordering.global_positions(df, [F.col("v").asc()])
    cum = ordering.prefix_sums(df, [F.col("v").asc()], {"c": F.col("v")})
    got = {r.v: (r.pos, r.cpos, r.c) for r in pos.join(cum.withColumnRenamed("pos", "cpos"), "v").collect()}
    total = 0
    for i, v in enumerate(sorted(got), 1):
        total += v
        assert got[v] == (i, i, total)
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 10**6)
    assert ordering._n_parts(df, None) == int(spark.conf.get("spark.sql.shuffle.partitions"))
