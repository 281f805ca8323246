"""Registered queries: sources (K), profiling (P), mapping (M), cleaning (C),
aggregation (A) and joins (J)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from cohortkit.functions.core import add_scalars

from cohortkit.operators import clean as C
from cohortkit.operators import mapping as M
from cohortkit.operators import orders as A
from cohortkit.operators import profile as P
from cohortkit.operators.scores import quantile_scores
from cohortkit.plans.registry import register
from cohortkit.plans.sqlfrag import DIRTY, EVENTS, LINES, RAW_DIRTY, STD, agg_orders, days, rfm
from cohortkit.session import ensure_checkpoint_dir
from cohortkit.sources import io
from cohortkit.sources import testdata as td

MONEY = 2   # sums of 2-decimal amounts: exact decimals, never on a rounding tie
LINE_MONEY = 4  # line amounts (price x discount) carry 4 decimals
RATIO = 6


def orders_clean(spark, sf):
    """Flagship input: orders mapped, cleaned (C13) and aggregated (A1)."""
    return A.aggregate_orders(C.clean_raw(td.table(spark, sf, "orders"), td.ORDERS_MAPPING, key=td.ORDERS_KEY))


def rfm_base(spark, sf):
    return A.rfm(orders_clean(spark, sf))


ORDERS_SQL = f"WITH {STD}, o AS ({agg_orders('std')})"
RFM_SQL = f"{ORDERS_SQL}, rfm AS ({rfm('o')})"


# ---------------------------------------------------------------- sources (K)

@register("k3_read_parquet", f"WITH {STD} SELECT * FROM std", {"order_total": MONEY})
def k3(spark, sf):
    return td.std_orders(spark, sf)


@register("k2_read_table", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer", {"c_acctbal": MONEY})
def k2(spark, sf):
    td.table(spark, sf, "customer").createOrReplaceTempView("cohortkit_customer")
    return io.read_table(spark, "cohortkit_customer").select("c_custkey", "c_mktsegment", "c_acctbal")


@register("k11_union_sources",
          f"WITH {STD}, {EVENTS} SELECT * FROM std UNION ALL SELECT * FROM ev",
          {"order_total": MONEY})
def k11(spark, sf):
    return io.union_sources(td.std_orders(spark, sf), td.std_events(spark, sf))


@register("k7_add_run_metadata",
          RFM_SQL + """ SELECT *, 'run-0001' AS run_id, TIMESTAMP '2024-05-01 10:00:00' AS run_timestamp,
          'rfm_quintiles' AS method, '{"n_quantiles": 5}' AS params FROM rfm""",
          {"Monetary": MONEY})
def k7(spark, sf):
    from datetime import datetime
    meta = io.run_meta("rfm_quintiles", {"n_quantiles": 5}, "run-0001", datetime(2024, 5, 1, 10))
    return io.add_run_metadata(rfm_base(spark, sf), meta)


@register("k9_latest_run",
          RFM_SQL + """ SELECT *, 'run-b' AS run_id, TIMESTAMP '2024-05-02 09:30:00' AS run_timestamp,
          'rfm' AS method, '{"k": 2}' AS params FROM rfm""",
          {"Monetary": MONEY})
def k9(spark, sf):
    """Two runs appended to a history table in the shared folder; newest read back."""
    from datetime import datetime
    import uuid
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/history-{uuid.uuid4().hex}"
    r = rfm_base(spark, sf)
    io.append_history(r, path, io.run_meta("rfm", {"k": 1}, "run-a", datetime(2024, 5, 1, 10)))
    io.append_history(r, path, io.run_meta("rfm", {"k": 2}, "run-b", datetime(2024, 5, 2, 9, 30)))
    return io.latest_run(spark, path)


# -------------------------------------------------------------- profiling (P)

CUST = "customer"


def cust(spark, sf):
    return td.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@register("p1_quality_report", f"""WITH {RAW_DIRTY}
SELECT count(*) AS total_rows,
       count(*) FILTER (WHERE cust IS NULL OR date_txt IS NULL OR total_txt IS NULL OR sat IS NULL
                        OR isnan(qty) OR isnan(price)) AS null_rows,
       count(*) FILTER (WHERE coalesce(cust < 0, false) OR coalesce(ord < 0, false) OR coalesce(qty < 0, false)
                        OR coalesce(price < 0, false) OR coalesce(sat < 0, false)) AS negative_rows,
       (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicate_rows
FROM raw""")
def p1(spark, sf):
    return P.quality_report(td.raw_dirty_orders(spark, sf))


@register("p2_nulls_by_column", f"""WITH {DIRTY}
SELECT * FROM (
  SELECT 'customer_id' AS column_name, count(*) FILTER (WHERE customer_id IS NULL) AS nulls, count(*) AS t FROM dirty
  UNION ALL SELECT 'order_id', count(*) FILTER (WHERE order_id IS NULL), count(*) FROM dirty
  UNION ALL SELECT 'order_date', count(*) FILTER (WHERE order_date IS NULL), count(*) FROM dirty
  UNION ALL SELECT 'order_total', count(*) FILTER (WHERE order_total IS NULL OR isnan(order_total)), count(*) FROM dirty
  UNION ALL SELECT 'quantity', count(*) FILTER (WHERE quantity IS NULL OR isnan(quantity)), count(*) FROM dirty
  UNION ALL SELECT 'unit_price', count(*) FILTER (WHERE unit_price IS NULL OR isnan(unit_price)), count(*) FROM dirty
  UNION ALL SELECT 'satisfaction', count(*) FILTER (WHERE satisfaction IS NULL OR isnan(satisfaction)), count(*) FROM dirty
) SELECT column_name, nulls, nulls * 100.0 / t AS pct FROM t WHERE nulls > 0""".replace(
    "SELECT * FROM (\n", "SELECT column_name, nulls, CAST(nulls * 100.0 / t AS DOUBLE) AS pct FROM (\n").replace(
    ") SELECT column_name, nulls, nulls * 100.0 / t AS pct FROM t WHERE nulls > 0", ") WHERE nulls > 0"),
    {"pct": RATIO})
def p2(spark, sf):
    return P.nulls_by_column(td.dirty_orders(spark, sf))


_NEG_SQL = """SELECT column_name, negatives, CAST(negatives * 100.0 / t AS DOUBLE) AS pct FROM (
  SELECT 'c_custkey' AS column_name, count(*) FILTER (WHERE c_custkey < 0) AS negatives, count(*) AS t FROM customer
  UNION ALL SELECT 'c_nationkey', count(*) FILTER (WHERE c_nationkey < 0), count(*) FROM customer
  UNION ALL SELECT 'c_acctbal', count(*) FILTER (WHERE c_acctbal < 0), count(*) FROM customer)"""


@register("p3_negatives_by_column", _NEG_SQL, {"pct": RATIO})
def p3(spark, sf):
    return P.negatives_by_column(cust(spark, sf))


@register("p4_cell_totals", f"""WITH {DIRTY}, n AS (
  SELECT count(*) FILTER (WHERE customer_id IS NULL) + count(*) FILTER (WHERE order_id IS NULL)
       + count(*) FILTER (WHERE order_date IS NULL) + count(*) FILTER (WHERE order_total IS NULL)
       + count(*) FILTER (WHERE quantity IS NULL) + count(*) FILTER (WHERE unit_price IS NULL)
       + count(*) FILTER (WHERE satisfaction IS NULL) AS null_cells,
         count(*) FILTER (WHERE order_total < 0) + count(*) FILTER (WHERE quantity < 0)
       + count(*) FILTER (WHERE unit_price < 0) + count(*) FILTER (WHERE satisfaction < 0) AS negative_cells
  FROM dirty)
SELECT CAST(null_cells AS BIGINT) AS null_cells, CAST(negative_cells AS BIGINT) AS negative_cells FROM n""")
def p4(spark, sf):
    return P.cell_totals(td.dirty_orders(spark, sf))


@register("p5_column_info", f"""WITH {DIRTY}
SELECT column_name, dtype, nulls, CAST(nulls * 100.0 / t AS DOUBLE) AS pct FROM (
  SELECT 'customer_id' AS column_name, 'string' AS dtype, count(*) FILTER (WHERE customer_id IS NULL) AS nulls, count(*) AS t FROM dirty
  UNION ALL SELECT 'order_id', 'string', count(*) FILTER (WHERE order_id IS NULL), count(*) FROM dirty
  UNION ALL SELECT 'order_date', 'timestamp_ntz', count(*) FILTER (WHERE order_date IS NULL), count(*) FROM dirty
  UNION ALL SELECT 'order_total', 'double', count(*) FILTER (WHERE order_total IS NULL), count(*) FROM dirty
  UNION ALL SELECT 'quantity', 'double', count(*) FILTER (WHERE quantity IS NULL), count(*) FROM dirty
  UNION ALL SELECT 'unit_price', 'double', count(*) FILTER (WHERE unit_price IS NULL), count(*) FROM dirty
  UNION ALL SELECT 'satisfaction', 'double', count(*) FILTER (WHERE satisfaction IS NULL), count(*) FROM dirty)""",
    {"pct": RATIO})
def p5(spark, sf):
    return P.column_info(td.dirty_orders(spark, sf))


@register("p6_validation_report", f"""WITH {DIRTY}
SELECT column_name, nulls, round(nulls * 100.0 / t, 2) AS pct_nulls, CAST(d AS BIGINT) AS distinct_values,
       (column_name IN ('customer_id', 'order_id', 'order_date', 'order_total') AND nulls * 100.0 / t > 1.0) AS error FROM (
  SELECT 'customer_id' AS column_name, count(*) FILTER (WHERE customer_id IS NULL) AS nulls, count(*) AS t, count(DISTINCT customer_id) AS d FROM dirty
  UNION ALL SELECT 'order_id', count(*) FILTER (WHERE order_id IS NULL), count(*), count(DISTINCT order_id) FROM dirty
  UNION ALL SELECT 'order_date', count(*) FILTER (WHERE order_date IS NULL), count(*), count(DISTINCT order_date) FROM dirty
  UNION ALL SELECT 'order_total', count(*) FILTER (WHERE order_total IS NULL), count(*), count(DISTINCT order_total) FROM dirty)""",
    {"pct_nulls": 2})
def p6(spark, sf):
    d = td.dirty_orders(spark, sf).select("customer_id", "order_id", "order_date", "order_total")
    return P.validation_report(d, ["customer_id", "order_id", "order_date", "order_total"], max_null_pct=1.0)


@register("p7_describe", """
SELECT 'c_acctbal' AS column_name, count(c_acctbal) AS count, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std,
       min(c_acctbal) AS min, quantile_cont(c_acctbal, 0.25) AS p25, quantile_cont(c_acctbal, 0.5) AS p50,
       quantile_cont(c_acctbal, 0.75) AS p75, max(c_acctbal) AS max FROM customer
UNION ALL
SELECT 'c_nationkey', count(c_nationkey), avg(c_nationkey), stddev_samp(c_nationkey), min(c_nationkey),
       quantile_cont(c_nationkey, 0.25), quantile_cont(c_nationkey, 0.5), quantile_cont(c_nationkey, 0.75),
       max(c_nationkey) FROM customer""",
    {"mean": 4, "std": 4, "min": MONEY, "p25": 4, "p50": 4, "p75": 4, "max": MONEY})
def p7(spark, sf):
    return P.describe(cust(spark, sf), ["c_acctbal", "c_nationkey"])


@register("p8_amount_stats", f"""{ORDERS_SQL}
SELECT avg(order_total) AS mean, quantile_cont(order_total, 0.5) AS median, min(order_total) AS min,
       max(order_total) AS max FROM o""", {"mean": RATIO, "median": 4, "min": MONEY, "max": MONEY})
def p8(spark, sf):
    return P.amount_stats(orders_clean(spark, sf))


@register("p9_severity_band", f"""WITH {DIRTY}, t AS (SELECT count(*) AS n FROM dirty), c AS (
  SELECT 'customer_id' AS column_name, count(*) FILTER (WHERE customer_id IS NULL) AS nulls, 0 AS negatives FROM dirty
  UNION ALL SELECT 'order_id', count(*) FILTER (WHERE order_id IS NULL), 0 FROM dirty
  UNION ALL SELECT 'order_date', count(*) FILTER (WHERE order_date IS NULL), 0 FROM dirty
  UNION ALL SELECT 'order_total', count(*) FILTER (WHERE order_total IS NULL), count(*) FILTER (WHERE order_total < 0) FROM dirty
  UNION ALL SELECT 'quantity', count(*) FILTER (WHERE quantity IS NULL), count(*) FILTER (WHERE quantity < 0) FROM dirty
  UNION ALL SELECT 'unit_price', count(*) FILTER (WHERE unit_price IS NULL), count(*) FILTER (WHERE unit_price < 0) FROM dirty
  UNION ALL SELECT 'satisfaction', count(*) FILTER (WHERE satisfaction IS NULL), count(*) FILTER (WHERE satisfaction < 0) FROM dirty)
SELECT column_name, nulls, CAST(negatives AS BIGINT) AS negatives,
       CASE WHEN greatest(nulls, negatives) = 0 THEN 'none'
            WHEN greatest(nulls, negatives) * 100.0 / n > 10 THEN 'high' ELSE 'low' END AS band
FROM c, t""")
def p9(spark, sf):
    return P.severity_band(td.dirty_orders(spark, sf))


@register("p10_order_totals_kpi", f"""{ORDERS_SQL}
SELECT count(DISTINCT order_id) AS n_orders, count(DISTINCT customer_id) AS n_customers,
       sum(order_total) AS revenue FROM o""", {"revenue": MONEY})
def p10(spark, sf):
    return P.order_totals_kpi(orders_clean(spark, sf))


@register("p11_value_counts", "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1")
def p11(spark, sf):
    return P.value_counts(cust(spark, sf), "c_mktsegment")


# ---------------------------------------------------------------- mapping (M)

@register("m2_type_profile", f"""WITH {RAW_DIRTY}
SELECT 'cust' AS column_name, 1.0 AS number_score, 0.0 AS date_score, 1.0 AS string_score
UNION ALL SELECT 'ord', 1.0, 0.0, 1.0
UNION ALL SELECT 'date_txt', avg(CASE WHEN TRY_CAST(date_txt AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END),
                 avg(CASE WHEN TRY_CAST(date_txt AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END), 1.0
          FROM raw WHERE date_txt IS NOT NULL
UNION ALL SELECT 'total_txt', avg(CASE WHEN TRY_CAST(total_txt AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END),
                 avg(CASE WHEN TRY_CAST(total_txt AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END), 1.0
          FROM raw WHERE total_txt IS NOT NULL
UNION ALL SELECT 'qty', 1.0, 0.0, 1.0
UNION ALL SELECT 'price', 1.0, 0.0, 1.0
UNION ALL SELECT 'sat', 1.0, 0.0, 1.0""", {"number_score": RATIO, "date_score": RATIO, "string_score": RATIO})
def m2(spark, sf):
    return M.type_profile(td.raw_dirty_orders(spark, sf), sample=None, numbers_as_dates=False)


@register("m2b_type_profile_numbers_as_dates", f"""WITH {RAW_DIRTY}, huge AS (
  SELECT *, CASE WHEN ord % 6 = 0 THEN NULL WHEN ord % 4 = 0 THEN qty * 1e19 ELSE qty END AS far, ord % 2 = 0 AS flag FROM raw)
SELECT 'ord' AS column_name, 1.0 AS number_score, 1.0 AS date_score, 1.0 AS string_score
UNION ALL SELECT 'far', 1.0, avg(CASE WHEN far BETWEEN -9.2e18 AND 9.2e18 THEN 1.0 ELSE 0.0 END), 1.0 FROM huge WHERE far IS NOT NULL
UNION ALL SELECT 'flag', 1.0, 0.0, 1.0
UNION ALL SELECT 'date_txt', avg(CASE WHEN TRY_CAST(date_txt AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END),
                 avg(CASE WHEN TRY_CAST(date_txt AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END), 1.0
          FROM raw WHERE date_txt IS NOT NULL""", {"number_score": RATIO, "date_score": RATIO, "string_score": RATIO})
def m2b(spark, sf):
    far = F.when(F.col("ord") % 6 == 0, F.lit(float("nan"))).when(F.col("ord") % 4 == 0, F.col("qty") * 1e19).otherwise(F.col("qty"))
    raw = td.raw_dirty_orders(spark, sf)
    return M.type_profile(raw.select("ord", far.alias("far"), (F.col("ord") % 2 == 0).alias("flag"), "date_txt"))


@register("m5_apply_mapping", f"WITH {DIRTY} SELECT * FROM dirty",
          {"order_total": MONEY, "unit_price": RATIO})
def m5(spark, sf):
    return td.dirty_orders(spark, sf)


@register("m6_derive_total", f"""WITH {RAW_DIRTY}
SELECT CAST(cust AS VARCHAR) AS customer_id, CAST(ord AS VARCHAR) AS order_id,
       TRY_CAST(date_txt AS TIMESTAMP) AS order_date, qty AS quantity, price AS unit_price,
       qty * price AS order_total FROM raw""", {"order_total": MONEY, "unit_price": RATIO})
def m6(spark, sf):
    return M.apply_mapping(td.raw_dirty_orders(spark, sf),
                           {"customer_id": "cust", "order_id": "ord", "order_date": "date_txt",
                            "quantity": "qty", "unit_price": "price"})


@register("m8_standardize", """
SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS transaction_id,
       o_orderdate AS transaction_date, o_totalprice AS transaction_amount FROM orders""",
          {"transaction_amount": MONEY})
def m8(spark, sf):
    return M.standardize(td.table(spark, sf, "orders"),
                         {"customer_id": "o_custkey", "transaction_id": "o_orderkey",
                          "transaction_date": "o_orderdate", "transaction_amount": "o_totalprice"})


_REPORT_MODEL = {**M.STANDARDISER_MODEL, "satisfaction": "double"}
_REPORT_COLUMNS = ("customer_id", "transaction_id", "transaction_date", "transaction_amount", "satisfaction", "qty")


@register("m8b_standardize_report", f"""WITH {DIRTY}, std AS (
  SELECT customer_id, order_id AS transaction_id, order_date AS transaction_date, order_total AS transaction_amount, satisfaction, quantity AS qty
  FROM dirty), counts AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
                      f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values FROM std" for c in _REPORT_COLUMNS)}),
pct AS (SELECT *, round(nulls * 100.0 / total_rows, 2) AS pct_nulls FROM counts)
SELECT *, CASE WHEN column_name <> 'qty' AND pct_nulls > 10 THEN printf('required column ''%s'' has %.2f%% nulls', column_name, pct_nulls) END AS error
FROM pct""", {"pct_nulls": 2})
def m8b(spark, sf):
    mapping = {"customer_id": "cust", "transaction_id": "ord", "transaction_date": "date_txt", "transaction_amount": "total_txt",
               "satisfaction": "sat", "qty": "qty"}
    return M.standardize_report(M.standardize(td.raw_dirty_orders(spark, sf), mapping, _REPORT_MODEL), _REPORT_MODEL)


@register("m9_normalize_ids", """
SELECT CAST(CAST(CAST(o_custkey AS DOUBLE) AS BIGINT) AS VARCHAR) AS customer_id, o_orderkey FROM orders""")
def m9(spark, sf):
    o = td.table(spark, sf, "orders").select(F.col("o_custkey").cast("double").alias("cid"), "o_orderkey")
    return o.select(M.normalize_id("cid").alias("customer_id"), "o_orderkey")


@register("m10_stringify_mixed", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""")
def m10(spark, sf):
    return M.stringify(td.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"),
                       ["o_orderkey", "o_custkey"])


# --------------------------------------------------------------- cleaning (C)

_DIRTY_COLS = "customer_id, order_id, order_date, order_total, quantity, unit_price, satisfaction"
_DR = {"order_total": MONEY, "unit_price": RATIO}


@register("c1_dedup_raw", f"""WITH {RAW_DIRTY}
SELECT DISTINCT CAST(cust AS VARCHAR) AS customer_id, CAST(ord AS VARCHAR) AS order_id,
       TRY_CAST(date_txt AS TIMESTAMP) AS order_date,
       CASE WHEN isnan(TRY_CAST(total_txt AS DOUBLE)) THEN NULL ELSE TRY_CAST(total_txt AS DOUBLE) END AS order_total,
       qty AS quantity, price AS unit_price, sat AS satisfaction FROM (SELECT DISTINCT * FROM raw)""", _DR)
def c1(spark, sf):
    return M.apply_mapping(C.dedup_raw(td.raw_dirty_orders(spark, sf)), td.DIRTY_MAPPING)


_REPEATED = """raw AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, 'changed' FROM orders WHERE o_orderkey % 5 = 0)"""


@register("c1b_dedup_repeated_keys", f"""WITH {_REPEATED}, d AS (SELECT DISTINCT * FROM raw WHERE o_totalprice > 0)
SELECT (SELECT count(*) FROM raw) AS rows_before, (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS removed_duplicates,
  count(*) AS rows_after, count(*) AS flow_rows, sum(o_totalprice) AS flow_total FROM d""", {"flow_total": MONEY})
def c1b(spark, sf):
    """Whole copies go, rows that share a key with other contents stay; C11 counts what the flow removes."""
    o = td.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    raw = (o.unionAll(o.where("o_orderkey % 7 = 0"))
           .unionAll(o.where("o_orderkey % 5 = 0").withColumn("o_orderpriority", F.lit("changed"))))
    stats = C.clean_stats_raw(raw, td.ORDERS_MAPPING).select("rows_before", "removed_duplicates", "rows_after")
    flow = C.clean_raw(raw, td.ORDERS_MAPPING, key=td.ORDERS_KEY).agg(
        F.count(F.lit(1)).alias("flow_rows"), F.sum("order_total").alias("flow_total"))
    return add_scalars(stats, flow)


@register("c2_dedup_mapped", f"WITH {DIRTY} SELECT DISTINCT * FROM dirty", _DR)
def c2(spark, sf):
    return C.dedup_mapped(td.dirty_orders(spark, sf))


@register("c3_drop_null_keys", f"""WITH {DIRTY} SELECT * FROM dirty WHERE customer_id IS NOT NULL
  AND order_id IS NOT NULL AND order_date IS NOT NULL AND order_total IS NOT NULL""", _DR)
def c3(spark, sf):
    return C.drop_null_keys(td.dirty_orders(spark, sf))


@register("c4_drop_any_null", f"""WITH {DIRTY} SELECT * FROM dirty WHERE customer_id IS NOT NULL
  AND order_id IS NOT NULL AND order_date IS NOT NULL AND order_total IS NOT NULL AND quantity IS NOT NULL
  AND unit_price IS NOT NULL AND satisfaction IS NOT NULL""", _DR)
def c4(spark, sf):
    return C.drop_any_null(td.dirty_orders(spark, sf))


@register("c5_drop_negative_rows", f"""WITH {DIRTY} SELECT * FROM dirty WHERE NOT (
  coalesce(order_total < 0, false) OR coalesce(quantity < 0, false) OR coalesce(unit_price < 0, false)
  OR coalesce(satisfaction < 0, false))""", _DR)
def c5(spark, sf):
    return C.drop_negative_rows(td.dirty_orders(spark, sf))


@register("c6_drop_negative_in", f"""WITH {DIRTY} SELECT * FROM dirty
  WHERE NOT coalesce(order_total < 0, false)""", _DR)
def c6(spark, sf):
    return C.drop_negative_in(td.dirty_orders(spark, sf), ["order_total"])


@register("c7_drop_null_in", f"""WITH {DIRTY} SELECT * FROM dirty
  WHERE customer_id IS NOT NULL AND satisfaction IS NOT NULL""", _DR)
def c7(spark, sf):
    return C.drop_null_in(td.dirty_orders(spark, sf), ["customer_id", "satisfaction"])


@register("c8_fill_nulls", f"""WITH {DIRTY} SELECT customer_id, order_id, order_date, order_total,
  quantity, unit_price, coalesce(satisfaction, 5.0) AS satisfaction,
  CAST(CASE WHEN satisfaction IS NULL THEN 1 ELSE 0 END AS INTEGER) AS filled FROM dirty""", _DR)
def c8(spark, sf):
    return C.fill_nulls(td.dirty_orders(spark, sf), {"satisfaction": 5.0})


@register("c9_strip_zero_total", f"WITH {DIRTY} SELECT * FROM dirty WHERE order_total > 0", _DR)
def c9(spark, sf):
    return C.strip_zero_total(td.dirty_orders(spark, sf))


@register("c9b_strip_zero_total_returns",
          f"WITH {DIRTY} SELECT * FROM dirty WHERE order_total IS DISTINCT FROM 0", _DR)
def c9b(spark, sf):
    return C.strip_zero_total(td.dirty_orders(spark, sf), returns_mode=True)


@register("c10_keep_positive_qty_price", f"""WITH {DIRTY} SELECT * FROM dirty
  WHERE quantity > 0 AND unit_price > 0""", _DR)
def c10(spark, sf):
    return C.keep_positive_qty_price(td.dirty_orders(spark, sf))


@register("c11_clean_stats", f"""WITH {DIRTY}, g AS (
  SELECT {_DIRTY_COLS}, count(*) AS copies FROM dirty GROUP BY ALL),
f AS (SELECT *, CASE WHEN customer_id IS NULL OR order_id IS NULL OR order_date IS NULL OR order_total IS NULL THEN 2
  WHEN coalesce(order_total < 0, false) OR coalesce(quantity < 0, false) OR coalesce(unit_price < 0, false)
       OR coalesce(satisfaction < 0, false) THEN 3
  WHEN NOT coalesce(order_total > 0, false) THEN 4 ELSE 0 END AS step FROM g)
SELECT CAST(sum(copies) AS BIGINT) AS rows_before, CAST(count(*) FILTER (WHERE step = 0) AS BIGINT) AS rows_after,
  CAST(sum(copies - 1) AS BIGINT) AS removed_duplicates, CAST(count(*) FILTER (WHERE step = 2) AS BIGINT) AS removed_nulls,
  CAST(count(*) FILTER (WHERE step = 3) AS BIGINT) AS removed_negatives,
  CAST(count(*) FILTER (WHERE step = 4) AS BIGINT) AS removed_zero_total,
  count(DISTINCT customer_id) FILTER (WHERE step = 0) AS unique_customers,
  count(DISTINCT order_id) FILTER (WHERE step = 0) AS unique_orders FROM f""")
def c11(spark, sf):
    return C.clean_stats(td.dirty_orders(spark, sf))


@register("c12_period_filter", f"""WITH {STD} SELECT * FROM std
  WHERE order_date >= TIMESTAMP '1996-01-01' AND order_date < TIMESTAMP '1998-01-01'""", {"order_total": MONEY})
def c12(spark, sf):
    return C.period_filter(td.std_orders(spark, sf), "1996-01-01", "1998-01-01")


@register("c13_clean_pipeline", f"""WITH {DIRTY} SELECT DISTINCT * FROM dirty
  WHERE customer_id IS NOT NULL AND order_id IS NOT NULL AND order_date IS NOT NULL AND order_total IS NOT NULL
  AND NOT (coalesce(order_total < 0, false) OR coalesce(quantity < 0, false) OR coalesce(unit_price < 0, false)
           OR coalesce(satisfaction < 0, false)) AND order_total > 0""", _DR)
def c13(spark, sf):
    return C.clean(td.dirty_orders(spark, sf))


@register("c13b_clean_returns_mode", f"""WITH {DIRTY} SELECT DISTINCT * FROM dirty
  WHERE customer_id IS NOT NULL AND order_id IS NOT NULL AND order_date IS NOT NULL AND order_total IS NOT NULL
  AND order_total IS DISTINCT FROM 0""", _DR)
def c13b(spark, sf):
    return C.clean(td.dirty_orders(spark, sf), remove_negatives=False)


# lineitem as raw rows: lines of an order with one quantity and discount look alike once mapped
_LINE_MAPPING = {"customer_id": "l_suppkey", "order_id": "l_orderkey", "order_date": "l_shipdate", "order_total": "l_quantity"}
_LINE_SQL = """raw AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 7 = 0),
ded AS (SELECT DISTINCT * FROM raw),
mapped AS (SELECT CAST(l_suppkey AS VARCHAR) AS customer_id, CAST(l_orderkey AS VARCHAR) AS order_id,
  CAST(l_shipdate AS TIMESTAMP) AS order_date, CAST(l_quantity AS DOUBLE) AS order_total FROM ded)"""


def raw_lines(spark, sf):
    """lineitem with every seventh order loaded twice."""
    li = td.table(spark, sf, "lineitem")
    return li.unionAll(li.where(F.col("l_orderkey") % 7 == 0))


@register("c13c_clean_line_level", f"WITH {_LINE_SQL} SELECT * FROM mapped WHERE order_total > 0", {"order_total": MONEY})
def c13c(spark, sf):
    return C.clean_raw(raw_lines(spark, sf), _LINE_MAPPING)


@register("c11b_clean_stats_line_level", f"""WITH {_LINE_SQL}
SELECT (SELECT count(*) FROM raw) AS rows_before, count(*) AS rows_after,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM ded) AS removed_duplicates, CAST(0 AS BIGINT) AS removed_nulls,
  CAST(0 AS BIGINT) AS removed_negatives, (SELECT count(*) FROM mapped WHERE NOT order_total > 0) AS removed_zero_total,
  count(DISTINCT customer_id) AS unique_customers, count(DISTINCT order_id) AS unique_orders FROM mapped WHERE order_total > 0""")
def c11b(spark, sf):
    return C.clean_stats_raw(raw_lines(spark, sf), _LINE_MAPPING)


@register("m5b_date_formats", """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE o_orderkey % 4
  WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) WHEN 1 THEN date_trunc('minute', CAST(o_orderdate AS TIMESTAMP))
  WHEN 2 THEN date_trunc('day', CAST(o_orderdate AS TIMESTAMP)) END AS order_date FROM orders""")
def m5b(spark, sf):
    o = td.table(spark, sf, "orders")
    day, k = F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_orderkey") % 4
    text = (F.when(k == 0, day.cast("string")).when(k == 1, F.date_format(day, "M/d/yyyy H:mm"))
            .when(k == 2, F.date_format(day, "dd.MM.yyyy")).otherwise(F.lit("31/31/31")))
    raw = o.select("o_custkey", "o_orderkey", "o_totalprice", text.alias("when"))
    from cohortkit.operators.mapping import apply_mapping
    return apply_mapping(raw, {**td.ORDERS_MAPPING, "order_date": "when"},
                         date_formats=("M/d/yyyy H:mm", "dd.MM.yyyy")).select("order_id", "order_date")


# ------------------------------------------------------------ aggregation (A)

@register("a1_aggregate_orders", f"WITH {DIRTY} {agg_orders('dirty', '> 0', sat=True)}",
          {"order_total": MONEY, "satisfaction": RATIO})
def a1(spark, sf):
    return A.aggregate_orders(td.dirty_orders(spark, sf))


@register("a2_aggregate_orders_with_returns", f"WITH {LINES} {agg_orders('lines', '<> 0')}",
          {"order_total": LINE_MONEY})
def a2(spark, sf):
    return A.aggregate_orders_with_returns(td.std_lines_with_returns(spark, sf))


@register("a3_rfm", f"{RFM_SQL} SELECT * FROM rfm", {"Monetary": MONEY})
def a3(spark, sf):
    return rfm_base(spark, sf)


@register("a3b_rfm_events", f"WITH {EVENTS}, o AS ({agg_orders('ev')}) {rfm('o')}", {"Monetary": MONEY})
def a3b(spark, sf):
    return A.rfm(A.aggregate_orders(td.std_events(spark, sf)))


@register("a4_length_static", f"""{ORDERS_SQL}
SELECT customer_id, min(order_date) AS first_purchase, max(order_date) AS last_purchase,
       count(DISTINCT order_id) AS n_orders,
       (epoch_us(max(order_date)) - epoch_us(min(order_date))) / 86400000000.0 AS L
FROM o GROUP BY customer_id""", {"L": RATIO})
def a4(spark, sf):
    return A.length_static(orders_clean(spark, sf))


LRFM_SQL = f"""{ORDERS_SQL}, ref AS (SELECT max(order_date) + INTERVAL 1 DAY AS ref FROM o),
lastp AS (SELECT customer_id, order_date, row_number() OVER (PARTITION BY customer_id
          ORDER BY order_date DESC, order_id DESC) AS rn FROM o),
rp AS (SELECT customer_id, avg({days('order_date', 'ref')}) AS R FROM lastp, ref WHERE rn <= 3 GROUP BY 1),
lrfm AS (SELECT b.customer_id, CAST({days('fd', 'ld')} AS DOUBLE) AS L, CAST(rp.R AS DOUBLE) AS R,
         CAST(b.nf AS DOUBLE) AS F, CAST(b.nm AS DOUBLE) AS M
  FROM (SELECT customer_id, min(order_date) AS fd, max(order_date) AS ld, count(DISTINCT order_id) AS nf,
               sum(order_total) AS nm FROM o GROUP BY 1) b JOIN rp USING (customer_id))"""


@register("a5_lrfm_static", f"{LRFM_SQL} SELECT * FROM lrfm", {"R": RATIO, "M": MONEY})
def a5(spark, sf):
    return A.lrfm_static(orders_clean(spark, sf), p=3)


@register("a6_last_purchase", f"""{ORDERS_SQL}
SELECT customer_id, max(order_date) AS last_purchase FROM o GROUP BY 1""")
def a6(spark, sf):
    return A.last_purchase(rfm_base(spark, sf), orders_clean(spark, sf))[0]


@register("a6b_mean_last_purchase", f"""{RFM_SQL}
SELECT make_timestamp(CAST(epoch_us((SELECT max(order_date) FROM o))
       - CAST((SELECT avg(Recency) FROM rfm) * 86400000000 AS BIGINT) AS BIGINT)) AS mean_last_purchase""")
def a6b(spark, sf):
    return A.last_purchase(rfm_base(spark, sf), orders_clean(spark, sf))[1]


@register("a7_histogram30", f"""{RFM_SQL}, x AS (SELECT CAST(Monetary AS DOUBLE) AS x FROM rfm),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 15 ELSE least(floor((x - lo) / ((hi - lo) / 30)), 29) END AS INTEGER) AS bin,
             count(*) AS count FROM x, r GROUP BY 1)
SELECT bin, lo + bin * (hi - lo) / 30 AS lo, lo + (bin + 1) * (hi - lo) / 30 AS hi, count FROM b, r""",
          {"lo": MONEY, "hi": MONEY})
def a7(spark, sf):
    return A.histogram(rfm_base(spark, sf), "Monetary", 30)


_SAT3 = """sat3 AS (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(1 + o_orderkey % 10 AS DOUBLE) AS quality,
  CAST(1 + o_orderkey % 7 AS DOUBLE) AS delivery, CAST(1 + (o_orderkey + o_custkey) % 5 AS DOUBLE) AS service FROM orders)"""


def sat3(spark, sf):
    o = td.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").cast("string").alias("customer_id"),
                    (1 + k % 10).cast("double").alias("quality"),
                    (1 + k % 7).cast("double").alias("delivery"),
                    (1 + (k + F.col("o_custkey")) % 5).cast("double").alias("service"))


@register("a8_satisfaction_weighted", f"""{LRFM_SQL}, {_SAT3}
SELECT lrfm.*, s.S FROM lrfm LEFT JOIN (SELECT customer_id, (1.0/3) * avg(quality) + (1.0/3) * avg(delivery)
  + (1.0/3) * avg(service) AS S FROM sat3 GROUP BY 1) s USING (customer_id)""",
          {"R": RATIO, "M": MONEY, "S": RATIO})
def a8(spark, sf):
    return A.satisfaction_weighted(A.lrfm_static(orders_clean(spark, sf), p=3), sat3(spark, sf))


def _qscore_sql(col):
    probs = "[0.0, 0.2, 0.4, 0.6, 0.8, 1.0]"
    inner = " + ".join(f"CAST({col} > e{col}[{j}] AS INTEGER)" for j in range(2, 6))
    return inner, f"quantile_cont({col}, {probs}) AS e{col}"


@register("a9_quantile_scores_lrfm", f"""{LRFM_SQL}, e AS (SELECT {_qscore_sql('L')[1]}, {_qscore_sql('R')[1]},
  {_qscore_sql('F')[1]}, {_qscore_sql('M')[1]} FROM lrfm)
SELECT customer_id, L, R, F, M,
  CAST(1 + (SELECT count(*) FROM (SELECT unnest(list_distinct(eL[2:5]))) t(v) WHERE L > v AND v > eL[1]) AS INTEGER) AS L_score,
  CAST(1 + (SELECT count(*) FROM (SELECT unnest(list_distinct(eR[2:5]))) t(v) WHERE R > v AND v > eR[1]) AS INTEGER) AS R_score,
  CAST(1 + (SELECT count(*) FROM (SELECT unnest(list_distinct(eF[2:5]))) t(v) WHERE F > v AND v > eF[1]) AS INTEGER) AS F_score,
  CAST(1 + (SELECT count(*) FROM (SELECT unnest(list_distinct(eM[2:5]))) t(v) WHERE M > v AND v > eM[1]) AS INTEGER) AS M_score
FROM lrfm, e""", {"R": RATIO, "M": MONEY})
def a9(spark, sf):
    return quantile_scores(A.lrfm_static(orders_clean(spark, sf), p=3), ["L", "R", "F", "M"])


# ------------------------------------------------------------------ joins (J)

@register("j1_orders_with_items", """
SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id, CAST(o.o_custkey AS VARCHAR) AS customer_id,
       o.o_orderdate AS order_date, array_to_string(i.products, ',') AS products,
       i.items_total, i.grand_total
FROM orders o JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
       list_sort(list(CAST(l_partkey AS VARCHAR))) AS products, sum(l_extendedprice) AS items_total,
       sum(l_extendedprice + l_extendedprice * l_tax) AS grand_total
  FROM lineitem GROUP BY 1) i ON CAST(o.o_orderkey AS VARCHAR) = i.order_id""",
          {"items_total": MONEY, "grand_total": MONEY})
def j1(spark, sf):
    o = td.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderdate").alias("order_date"))
    li = td.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"))
    out = A.orders_with_items(o, li)
    return out.withColumn("products", F.array_join("products", ","))


@register("j2_label_join_left", f"""{RFM_SQL}
SELECT s.customer_id, s.segment, r.Monetary FROM (SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
  c_mktsegment AS segment FROM customer) s LEFT JOIN rfm r USING (customer_id)""", {"Monetary": MONEY})
def j2(spark, sf):
    labels = td.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"),
                                                    F.col("c_mktsegment").alias("segment"))
    return A.label_join_left(labels, rfm_base(spark, sf).select("customer_id", "Monetary"))


@register("j3_rfm_vs_lrfm", f"""{LRFM_SQL}, {rfm('o').join(['rfm AS (', ')'])}
SELECT lrfm.*, rfm.Recency, rfm.Frequency, rfm.Monetary FROM lrfm JOIN rfm USING (customer_id)""",
          {"R": RATIO, "M": MONEY, "Monetary": MONEY})
def j3(spark, sf):
    o = orders_clean(spark, sf)
    return A.inner_join(A.lrfm_static(o, p=3), A.rfm(o))


@register("j5_semi_filter", f"""{ORDERS_SQL}
SELECT * FROM o WHERE customer_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')""",
          {"order_total": MONEY})
def j5(spark, sf):
    keep = td.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").cast("string").alias("customer_id"))
    return A.semi_filter(orders_clean(spark, sf), keep)




# ------------------------------------------------------- sinks round trips (K)

@register("k1_read_csv", f"""WITH {STD} SELECT CAST(customer_id AS INTEGER) AS customer_id, CAST(order_id AS INTEGER) AS order_id,
  order_date, order_total FROM std""", {"order_total": MONEY})
def k1(spark, sf):
    """K6 then K1: orders written as CSV in the shared folder, read back (types inferred)."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    io.write_csv(td.std_orders(spark, sf), path)
    return io.read_csv(spark, path)


@register("k6_csv_round_trip", f"WITH {STD} SELECT * FROM std", {"order_total": MONEY})
def k6(spark, sf):
    """K6 then K1 with a declared schema."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    orders = td.std_orders(spark, sf)
    return io.read_csv(spark, io.write_csv(orders, path), schema=orders.schema)


@register("k8_history_new_column", RFM_SQL + """ SELECT customer_id, 'run-a' AS run_id, CAST(NULL AS INTEGER) AS extra FROM rfm
  UNION ALL SELECT customer_id, 'run-b', 7 FROM rfm""")
def k8(spark, sf):
    """Two runs of one history; the second brings a new column."""
    from datetime import datetime
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    r = rfm_base(spark, sf)
    io.append_history(r, path, io.run_meta("rfm", {}, "run-a", datetime(2024, 5, 1, 10)))
    io.append_history(r.withColumn("extra", F.lit(7)), path, io.run_meta("rfm", {}, "run-b", datetime(2024, 5, 2, 9)))
    return io.read_history(spark, path).select("customer_id", "run_id", "extra")


@register("k5_preview", f"""WITH {RAW_DIRTY}, t AS (SELECT *, row_number() OVER (ORDER BY ord) AS _n FROM raw)
SELECT coalesce(CAST(cust AS VARCHAR), '') AS cust, coalesce(CAST(ord AS VARCHAR), '') AS ord, coalesce(date_txt, '') AS date_txt,
  coalesce(total_txt, '') AS total_txt, coalesce(CAST(qty AS VARCHAR), '') AS qty, coalesce(CAST(price AS VARCHAR), '') AS price,
  coalesce(CAST(sat AS VARCHAR), '') AS sat FROM t WHERE _n <= 10""")
def k5(spark, sf):
    return io.preview(td.raw_dirty_orders(spark, sf).orderBy("ord"), 10)


@register("k10_write_run_parquet",
          RFM_SQL + """ SELECT *, 'run-parquet' AS run_id, TIMESTAMP '2024-05-03 08:00:00' AS run_timestamp,
          'rfm_quintiles' AS method, '{"n_quantiles": 5}' AS params FROM rfm""",
          {"Monetary": MONEY})
def k10(spark, sf):
    from datetime import datetime
    import uuid
    prefix = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    meta = io.run_meta("rfm_quintiles", {"n_quantiles": 5}, "run-parquet", datetime(2024, 5, 3, 8))
    path = io.write_run_parquet(rfm_base(spark, sf), prefix, meta)
    return spark.read.parquet(path)


@register("m3_auto_map", """SELECT * FROM (VALUES ('customer_id', 'customer_id', 1.0::DOUBLE), ('order_id', 'order_number', 1.0),
  ('order_date', 'created_at', 1.0), ('order_total', 'total_price', 1.0)) t(target, column_name, confidence)
WHERE (SELECT count(*) FROM orders) > 0""", {"confidence": RATIO})
def m3(spark, sf):
    o = td.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_number"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("total_price"),
        F.col("o_orderpriority").alias("priority"))
    return M.auto_map(o, threshold=0.5, sample=None)
