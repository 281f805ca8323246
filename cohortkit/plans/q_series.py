"""Registered queries: interval and monthly series (T, J4, J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit.operators import orders as A
from cohortkit.operators import series as T
from cohortkit.plans.q_base import LINE_MONEY, MONEY, RATIO, orders_clean
from cohortkit.plans.registry import register
from cohortkit.plans.sqlfrag import DIRTY, EVENTS, LINES, STD, agg_orders, days
from cohortkit.sources import testdata as td

N = 4
P = 3


def returns_orders(spark, sf):
    """Orders with returns kept (lines: flag R -> negative), A2."""
    return A.aggregate_orders_with_returns(td.std_lines_with_returns(spark, sf))


def binned(spark, sf, n=N):
    o = returns_orders(spark, sf)
    return T.assign_interval(o, T.equal_intervals(o, n))


RET_SQL = f"WITH {LINES}, o AS ({agg_orders('lines', '<> 0')})"
BOUNDS = f"""b AS (SELECT min(epoch_us(order_date)) FILTER (WHERE order_total >= 0) AS t0,
  max(epoch_us(order_date)) FILTER (WHERE order_total >= 0) + 86400000000
  - min(epoch_us(order_date)) FILTER (WHERE order_total >= 0) AS span, {N} AS n FROM o)"""
BINNED = f"""{RET_SQL}, {BOUNDS},
bi AS (SELECT o.*, CAST(greatest(0, ((epoch_us(order_date) - t0) * n + span - 1) // span - 1) AS INTEGER) AS interval
       FROM o, b WHERE epoch_us(order_date) - t0 BETWEEN 0 AND span),
binned AS (SELECT bi.*, make_timestamp(CAST(t0 + ((interval + 1) * span) // n AS BIGINT)) AS interval_end FROM bi, b)"""


def long_sql(src: str, s_expr: str | None, freq: str = "count(DISTINCT order_id) FILTER (WHERE order_total >= 0)") -> str:
    s = f", {s_expr} AS S" if s_expr else ""
    return f"""SELECT g.customer_id, g.interval,
  CAST(coalesce({days('fp', 'lp')}, 0) AS DOUBLE) AS L, CAST(coalesce(r.R, 0) AS DOUBLE) AS R,
  CAST(g.nf AS DOUBLE) AS F, CAST(g.nm AS DOUBLE) AS M{s}
FROM (SELECT customer_id, interval, min(order_date) FILTER (WHERE order_total >= 0) AS fp,
             max(order_date) FILTER (WHERE order_total >= 0) AS lp, {freq} AS nf,
             coalesce(sum(order_total) FILTER (WHERE order_total >= 0), 0) AS nm,
             avg(CASE WHEN order_total < 0 THEN 1.0 ELSE 0.0 END) AS rate
             {', avg(satisfaction) AS sv' if s_expr and 'sv' in s_expr else ''}
      FROM {src} GROUP BY 1, 2) g
LEFT JOIN (SELECT customer_id, interval, avg({days('order_date', 'interval_end')}) AS R FROM (
      SELECT *, row_number() OVER (PARTITION BY customer_id, interval ORDER BY order_date DESC, order_id DESC) AS rn
      FROM {src} WHERE order_total >= 0) WHERE rn <= {P} GROUP BY 1, 2) r USING (customer_id, interval)"""


RATE_SCORE = """CASE WHEN rate * 100 = 0 THEN 9.0 WHEN rate * 100 <= 2 THEN 8.5 WHEN rate * 100 <= 5 THEN 8.0 - rate * 10
  WHEN rate * 100 <= 10 THEN 6.5 - rate * 5 WHEN rate * 100 <= 20 THEN 4.0 ELSE 2.0 END"""
LONG_SQL = f"{BINNED}, lg AS ({long_sql('binned', RATE_SCORE)})"
_LR = {"R": RATIO, "M": LINE_MONEY, "S": RATIO}


@register("t1_equal_intervals", f"""{RET_SQL}, {BOUNDS}
SELECT CAST(i AS INTEGER) AS interval, make_timestamp(CAST(t0 + (i * span) // n AS BIGINT)) AS lo,
       make_timestamp(CAST(t0 + ((i + 1) * span) // n AS BIGINT)) AS hi FROM b, range({N}) t(i)""")
def t1(spark, sf):
    o = returns_orders(spark, sf)
    b = T.equal_intervals(o, N)
    return b.select(F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("interval"), "_t0", "_span", "_n").select(
        F.col("interval").cast("int").alias("interval"), T.interval_edge(F.col("interval")).alias("lo"),
        T.interval_edge(F.col("interval") + 1).alias("hi"))


@register("t2_assign_interval", f"{BINNED} SELECT customer_id, order_id, order_date, interval FROM binned")
def t2(spark, sf):
    return binned(spark, sf).select("customer_id", "order_id", "order_date", "interval")


@register("t4_lrfms_long", f"{LONG_SQL} SELECT * FROM lg", _LR)
def t4(spark, sf):
    return T.lrfms_long(binned(spark, sf), P, compute_s=True)


@register("t5_return_rate", f"""{BINNED} SELECT customer_id, interval,
  avg(CASE WHEN order_total < 0 THEN 1.0 ELSE 0.0 END) AS return_rate FROM binned GROUP BY 1, 2""",
          {"return_rate": RATIO})
def t5(spark, sf):
    return binned(spark, sf).groupBy("customer_id", "interval").agg(
        F.avg(F.when(F.col("order_total") < 0, 1.0).otherwise(0.0)).alias("return_rate"))


@register("t6_return_rate_score", f"""{BINNED}, r AS (SELECT customer_id, interval,
  avg(CASE WHEN order_total < 0 THEN 1.0 ELSE 0.0 END) AS rate FROM binned GROUP BY 1, 2)
SELECT customer_id, interval, rate, {RATE_SCORE} AS score FROM r""", {"rate": RATIO, "score": RATIO})
def t6(spark, sf):
    r = binned(spark, sf).groupBy("customer_id", "interval").agg(
        F.avg(F.when(F.col("order_total") < 0, 1.0).otherwise(0.0)).alias("rate"))
    return r.withColumn("score", T.return_rate_score(F.col("rate")))


SURVEY_BINNED = f"""WITH {DIRTY}, o AS ({agg_orders('dirty', '<> 0', sat=True)}), {BOUNDS},
bi AS (SELECT o.*, CAST(greatest(0, ((epoch_us(order_date) - t0) * n + span - 1) // span - 1) AS INTEGER) AS interval
       FROM o, b WHERE epoch_us(order_date) - t0 BETWEEN 0 AND span),
binned AS (SELECT bi.*, make_timestamp(CAST(t0 + ((interval + 1) * span) // n AS BIGINT)) AS interval_end FROM bi, b)"""


@register("t7_survey_s", f"{SURVEY_BINNED}, lg AS ({long_sql('binned', 'coalesce(sv, ' + RATE_SCORE + ')')}) SELECT * FROM lg", _LR)
def t7(spark, sf):
    o = A.aggregate_orders_with_returns(td.dirty_orders(spark, sf))
    b = T.assign_interval(o, T.equal_intervals(o, N))
    return T.lrfms_long(b, P, compute_s=True, use_survey=True)


def _wide_sql():
    cols = []
    for i in range(N):
        for m in ["L", "R", "F", "M", "S"]:
            cols.append(f"coalesce(max({m}) FILTER (WHERE interval = {i}), 0.0) AS {m}_t{i}")
    return f"{LONG_SQL} SELECT customer_id, {', '.join(cols)} FROM lg GROUP BY customer_id"


@register("t9_pivot_wide", _wide_sql(), {f"{m}_t{i}": (LINE_MONEY if m == "M" else RATIO) for i in range(N) for m in "LRFMS"})
def t9(spark, sf):
    lg = T.lrfms_long(binned(spark, sf), P, compute_s=True)
    return T.pivot_wide(lg, ["L", "R", "F", "M", "S"], T.present_intervals(lg))


# --------------------------------------------------------- calendar intervals

EV_ORDERS = f"WITH {EVENTS}, o AS ({agg_orders('ev')})"
CAL14 = f"""{EV_ORDERS}, bb AS (SELECT min(order_date) AS s, max(order_date) + INTERVAL 14 DAY AS e FROM o),
ed AS (SELECT s + to_days(CAST(14 * k AS INTEGER)) AS edge FROM bb, range(0, 1000) t(k) WHERE s + to_days(CAST(14 * k AS INTEGER)) <= e),
edges AS (SELECT CAST(row_number() OVER (ORDER BY edge) - 1 AS INTEGER) AS interval, edge AS lo,
          lead(edge) OVER (ORDER BY edge) AS hi FROM ed QUALIFY hi IS NOT NULL)"""


@register("t3_calendar_intervals_14d", f"{CAL14} SELECT * FROM edges")
def t3(spark, sf):
    o = A.aggregate_orders(td.std_events(spark, sf))
    return T.calendar_edges(o, months=None, days=14)


@register("t3c_assign_14d", f"""{EV_ORDERS}, bb AS (SELECT min(order_date) AS s FROM o),
n AS (SELECT customer_id, order_id, s, CAST(datediff('microsecond', s, order_date) // 1209600000000 AS INTEGER) AS interval FROM o, bb)
SELECT customer_id, order_id, interval, s + to_days((interval + 1) * 14) AS interval_end FROM n""")
def t3c(spark, sf):
    o = A.aggregate_orders(td.std_events(spark, sf))
    return T.assign_day_interval(o, 14).select("customer_id", "order_id", "interval", "interval_end")


@register("f2b_minmax_constant", f"""WITH {STD}, o AS ({agg_orders('std')}), x AS (
  SELECT customer_id, sum(order_total) AS M, 7.0 AS c FROM o GROUP BY 1)
SELECT customer_id, (M - min(M) OVER ()) / (max(M) OVER () - min(M) OVER ()) AS M, 0.5 AS c FROM x""", {"M": RATIO, "c": RATIO})
def f2b(spark, sf):
    per = orders_clean(spark, sf).groupBy("customer_id").agg(F.sum("order_total").alias("M")).withColumn("c", F.lit(7.0))
    return T.minmax_scale(per, ["M", "c"], zero_range=0.5, fill_null=0.0, clip=True)


CAL2M = f"""{STD}, o AS ({agg_orders('std')}), bb AS (SELECT min(order_date) AS s, max(order_date) + INTERVAL 1 DAY AS e FROM o),
me AS (SELECT last_day(CAST(date_trunc('month', s) AS DATE) + to_months(CAST(k AS INTEGER))) + (s - date_trunc('day', s)) AS edge, s, e
       FROM bb, range(0, 2000) t(k)),
me2 AS (SELECT edge, e, row_number() OVER (ORDER BY edge) - 1 AS r FROM me WHERE edge >= s AND edge <= e + INTERVAL 3 MONTH),
ed AS (SELECT edge FROM me2 WHERE r % 2 = 0 AND edge <= e),
edges AS (SELECT CAST(row_number() OVER (ORDER BY edge) - 1 AS INTEGER) AS interval, edge AS lo,
          lead(edge) OVER (ORDER BY edge) AS hi FROM ed QUALIFY hi IS NOT NULL)"""


@register("t3b_calendar_intervals_2m", f"WITH {CAL2M} SELECT interval, CAST(lo AS TIMESTAMP) AS lo, CAST(hi AS TIMESTAMP) AS hi FROM edges")
def t3b(spark, sf):
    return T.calendar_edges(orders_clean(spark, sf), months=2)


CAL_BINNED = f"""WITH {CAL2M}, cb AS (SELECT o.*, edges.interval, CAST(edges.hi AS TIMESTAMP) AS interval_end FROM o JOIN edges
  ON (o.order_date > edges.lo OR (edges.interval = 0 AND o.order_date = edges.lo)) AND o.order_date <= edges.hi)"""


@register("j6_interval_assign", f"{CAL_BINNED} SELECT customer_id, order_id, interval, interval_end FROM cb")
def j6(spark, sf):
    o = orders_clean(spark, sf)
    return T.assign_calendar_interval(o, T.calendar_edges(o, months=2)).select(
        "customer_id", "order_id", "interval", "interval_end")


DENSE_SQL = f"""{CAL_BINNED}, lg AS ({long_sql('cb', None, 'count(*) FILTER (WHERE order_total >= 0)')}),
dense AS (SELECT c.customer_id, i.interval, coalesce(lg.L, 0.0) AS L, lg.R AS R, coalesce(lg.F, 0.0) AS F,
  coalesce(lg.M, 0.0) AS M FROM (SELECT DISTINCT customer_id FROM lg) c CROSS JOIN (SELECT interval FROM edges) i
  LEFT JOIN lg USING (customer_id, interval))"""


def dense(spark, sf):
    o = orders_clean(spark, sf)
    edges = T.calendar_edges(o, months=2)
    lg = T.lrfms_long(T.assign_calendar_interval(o, edges), P, frequency="rows")
    # the script leaves R' empty for intervals without purchases
    return T.dense_series(lg, edges)


@register("t11_dense_series", f"{DENSE_SQL} SELECT * FROM dense", {"R": RATIO, "M": MONEY})
def t11(spark, sf):
    return dense(spark, sf)


@register("t16_active_customers", f"""{DENSE_SQL} SELECT customer_id, sum(F) AS total_F FROM dense GROUP BY 1
  HAVING sum(F) >= 5""")
def t16(spark, sf):
    return T.active_customers(dense(spark, sf))


# -------------------------------------------------------------- monthly line

MONTHLY = f"""{STD}, o AS ({agg_orders('std')}),
mo AS (SELECT customer_id, CAST(date_trunc('month', order_date) AS TIMESTAMP) AS month, min(order_date) AS fd,
       max(order_date) AS last_date, CAST(count(DISTINCT order_id) AS DOUBLE) AS F, CAST(sum(order_total) AS DOUBLE) AS M
       FROM o GROUP BY 1, 2),
monthly AS (SELECT customer_id, month, CAST({days('fd', 'last_date')} AS DOUBLE) AS L,
  CAST({days('last_date', "(month + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND)")} AS DOUBLE) AS R_prime, F, M, last_date FROM mo),
spine AS (SELECT customer_id, CAST(unnest(generate_series(m0, mx, INTERVAL 1 MONTH)) AS TIMESTAMP) AS month
  FROM (SELECT customer_id, min(month) AS m0 FROM monthly GROUP BY 1), (SELECT max(month) AS mx FROM monthly)),
filled AS (SELECT s.customer_id, s.month, coalesce(m.L, 0.0) AS L,
  CAST({days("last_value(m.last_date IGNORE NULLS) OVER (PARTITION BY s.customer_id ORDER BY s.month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(s.month + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND)")} AS DOUBLE) AS R_prime,
  coalesce(m.F, 0.0) AS F, coalesce(m.M, 0.0) AS M FROM spine s LEFT JOIN monthly m USING (customer_id, month))"""


def monthly(spark, sf):
    return T.monthly_lrfm(orders_clean(spark, sf))


def filled(spark, sf):
    m = monthly(spark, sf)
    return T.fill_series(T.month_spine(m), m)


@register("t12_monthly_lrfm", f"WITH {MONTHLY} SELECT * FROM monthly", {"M": MONEY})
def t12(spark, sf):
    return monthly(spark, sf)


@register("t13_month_spine", f"WITH {MONTHLY} SELECT * FROM spine")
def t13(spark, sf):
    return T.month_spine(monthly(spark, sf))


@register("t14_fill_series", f"WITH {MONTHLY} SELECT * FROM filled", {"M": MONEY})
def t14(spark, sf):
    return filled(spark, sf)


@register("j4_series_left_join", f"""WITH {MONTHLY} SELECT s.customer_id, s.month, m.F, m.last_date
  FROM spine s LEFT JOIN monthly m USING (customer_id, month)""")
def j4(spark, sf):
    m = monthly(spark, sf)
    return T.month_spine(m).join(m.select("customer_id", "month", "F", "last_date"), ["customer_id", "month"], "left")


NORM = """norm AS (SELECT customer_id, month, (L - min(L) OVER ()) / (max(L) OVER () - min(L) OVER ()) AS L,
  (R_prime - min(R_prime) OVER ()) / (max(R_prime) OVER () - min(R_prime) OVER ()) AS R_prime,
  (F - min(F) OVER ()) / (max(F) OVER () - min(F) OVER ()) AS F,
  (M - min(M) OVER ()) / (max(M) OVER () - min(M) OVER ()) AS M FROM filled)"""


def normed(spark, sf):
    return T.minmax_scale(filled(spark, sf), ["L", "R_prime", "F", "M"])


@register("f2_minmax_scale", f"WITH {MONTHLY}, {NORM} SELECT * FROM norm",
          {"L": RATIO, "R_prime": RATIO, "F": RATIO, "M": RATIO})
def f2(spark, sf):
    return normed(spark, sf)


@register("t15_pack_series", f"""WITH {MONTHLY} SELECT customer_id, string_agg(CAST(round(F * 100) / 100 AS VARCHAR)
  || ':' || CAST(round(M * 100) / 100 AS VARCHAR), ';' ORDER BY month) AS series FROM filled GROUP BY 1""")
def t15(spark, sf):
    p = T.pack_series(filled(spark, sf), "month", ["F", "M"])
    fmt = F.transform("series", lambda a: F.concat_ws(
        ":", *[(F.round(a[i] * 100) / 100).cast("string") for i in range(2)]))
    return p.select("customer_id", F.array_join(fmt, ";").alias("series"))


LABELS = """lab AS (SELECT customer_id, CAST(CAST(customer_id AS BIGINT) % 4 AS INTEGER) AS cluster FROM (SELECT DISTINCT customer_id FROM filled))"""


def stand_in_labels(df):
    return df.select("customer_id").distinct().select(
        "customer_id", (F.col("customer_id").cast("bigint") % 4).cast("int").alias("cluster"))


@register("t20_cluster_trends", f"""WITH {MONTHLY}, {NORM}, {LABELS},
ix AS (SELECT n.*, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY month) - 1 AS INTEGER) AS idx FROM norm n),
per AS (SELECT cluster, idx, avg(M) AS avg_value FROM ix JOIN lab USING (customer_id) GROUP BY 1, 2)
SELECT *, avg(avg_value) OVER (PARTITION BY cluster ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS trend FROM per""",
          {"avg_value": RATIO, "trend": RATIO})
def t20(spark, sf):
    n = normed(spark, sf)
    return T.cluster_trends(n, stand_in_labels(n))


@register("t21_churn_risk", f"""WITH {MONTHLY}, {NORM}, {LABELS},
ix AS (SELECT n.*, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY month) - 1 AS DOUBLE) AS i FROM norm n),
g AS (SELECT customer_id, coalesce(regr_slope(M, i), 0.0) AS sl, avg(M) AS mn, count(*) AS n FROM ix GROUP BY 1)
SELECT customer_id AS User_ID, cluster AS Segmento_ID,
  CASE cluster WHEN 0 THEN 'Important Retention (Estrellas)' WHEN 1 THEN 'Loyal Customers (Fieles)'
    WHEN 2 THEN 'Developmental (En Crecimiento)' WHEN 3 THEN 'General Customers (Básicos)' ELSE 'Otros' END AS Nombre_Segmento,
  round(CASE WHEN n > 1 THEN sl ELSE 0.0 END, 4) AS Pendiente_Tendencia,
  CASE WHEN (CASE WHEN n > 1 THEN sl ELSE 0.0 END) < -0.05 THEN 'ALTO (Abandono Inminente)'
       WHEN (CASE WHEN n > 1 THEN sl ELSE 0.0 END) < -0.01 THEN 'Medio (Perdiendo Interés)' ELSE 'Bajo' END AS Nivel_de_Riesgo,
  round(mn, 4) AS Valor_Monetario_Promedio FROM g JOIN lab USING (customer_id)""",
          {"Pendiente_Tendencia": 3, "Valor_Monetario_Promedio": 3})
def t21(spark, sf):
    n = normed(spark, sf)
    return T.churn_risk(n, stand_in_labels(n))


