"""Plan checks: pushdown into the parquet scan, no Python in SQL-only paths."""

from cohortkit.operators.clean import period_filter
from cohortkit.sources import testdata as td
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_filter_pushed_to_scan(spark):
    df = period_filter(td.std_orders(spark, SF001), "1996-01-01", "1998-01-01")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_mapping_reads_only_needed_columns(spark):
    plan = _plan(td.std_orders(spark, SF001))
    assert "o_orderpriority" not in plan and "o_orderstatus" not in plan


def test_rfm_hashes_other_columns_but_does_not_exchange_them(spark):
    """Whole raw rows are compared, so all columns are read; the exchange carries the key, the hash and the mapped ones."""
    from cohortkit.plans.q_base import rfm_base
    plan = _plan(rfm_base(spark, SF001))
    kept = [line for line in plan.splitlines() if "partial_first(" in line]
    assert kept and all("o_orderpriority" not in line and "o_orderstatus" not in line for line in kept)


def test_segments_have_no_python_udf(spark):
    from cohortkit.plans.q_segments import segmented
    plan = _plan(segmented(spark, SF001))
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
