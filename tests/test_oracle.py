"""Registered queries against their DuckDB oracles on sf0.001 (fast subset)."""

import math

import duckdb
import pytest

from cohortkit.sources.testdata import TABLES
from tests.conftest import SF001

FAST = ["a1_aggregate_orders", "a2_aggregate_orders_with_returns", "a3_rfm", "a5_lrfm_static", "c11_clean_stats",
        "c13_clean_pipeline", "p1_quality_report", "p2_nulls_by_column", "p6_validation_report", "s8_rfm_quintile_segments",
        "s9_abc", "h1_segment_summary", "h6_top10_per_segment", "h7_pareto_curve", "h19_boxplot_stats",
        "t4_lrfms_long", "t9_pivot_wide", "t14_fill_series", "t21_churn_risk", "f9_f11_f12_label_metrics",
        "f10_silhouette_euclid", "f20_density_peaks", "j6_interval_assign", "k9_latest_run",
        "m2b_type_profile_numbers_as_dates", "m8b_standardize_report", "f18_pca2"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(_norm(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF001)
    res = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "label" in df.columns and sum(r["count"] for r in rows) == 150
