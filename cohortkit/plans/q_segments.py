"""Registered queries: scores and rules (S) and result marts (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit.operators import marts as H
from cohortkit.operators import orders as A
from cohortkit.operators import scores as S
from cohortkit.operators.ordering import exact_quantiles
from cohortkit.plans.flows import abc_method, rfm_quintiles
from cohortkit.plans.q_base import LRFM_SQL, MONEY, RATIO, RFM_SQL, ORDERS_SQL, orders_clean, rfm_base
from cohortkit.plans.registry import register
from cohortkit.plans.sqlfrag import rules_case, scored, with_code
from cohortkit.session import cut

SCORED_SQL = f"{RFM_SQL}, sc AS ({scored('rfm')}), coded AS ({with_code('sc')})"
SEG_SQL = f"{SCORED_SQL}, seg AS (SELECT *, {rules_case('RFM_Score', S.SEGMENT_RULES)} AS segment FROM coded)"
_R = {"Monetary": MONEY}


def segmented(spark, sf):
    return rfm_quintiles(orders_clean(spark, sf))


@register("s1_qcut_score", f"""{RFM_SQL} SELECT customer_id, Monetary,
  CAST(1 + (CAST(Monetary > e[2] AS INTEGER) + CAST(Monetary > e[3] AS INTEGER) + CAST(Monetary > e[4] AS INTEGER)
  + CAST(Monetary > e[5] AS INTEGER)) AS INTEGER) AS Monetary_score
  FROM rfm, (SELECT quantile_cont(Monetary, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM rfm)""", _R)
def s1(spark, sf):
    return S.qcut_score(rfm_base(spark, sf).select("customer_id", "Monetary"), "Monetary", "Monetary_score")


@register("s1b_qcut_edges", f"""{RFM_SQL} SELECT e[1] AS e0, e[2] AS e1, e[3] AS e2, e[4] AS e3, e[5] AS e4, e[6] AS e5
  FROM (SELECT quantile_cont(Monetary, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM rfm)""",
          {f"e{i}": 4 for i in range(6)})
def s1b(spark, sf):
    return S.qcut_edges(rfm_base(spark, sf), "Monetary", 5)


@register("s2_rank_qcut_score", f"""{RFM_SQL} SELECT customer_id, Frequency,
  CAST(greatest(1, (5 * (row_number() OVER (ORDER BY Frequency, customer_id) - 1) + n - 2) // (n - 1)) AS INTEGER)
  AS Frequency_score FROM rfm, (SELECT count(*) AS n FROM rfm)""")
def s2(spark, sf):
    return S.rank_qcut_score(rfm_base(spark, sf).select("customer_id", "Frequency"), "Frequency",
                             "Frequency_score")


@register("s3_rfm_code", f"{SCORED_SQL} SELECT * FROM coded", _R)
def s3(spark, sf):
    return S.rfm_scores(rfm_base(spark, sf))


@register("s4_assign_segment_first", f"""{SEG_SQL} SELECT customer_id, RFM_Score, segment FROM seg""")
def s4(spark, sf):
    return segmented(spark, sf).select("customer_id", "RFM_Score", "segment")


@register("s5_assign_segment_last", f"""{SCORED_SQL}
SELECT customer_id, RFM_Score, {rules_case('RFM_Score', S.APP_RULES, 'last', 'prefix', "'Other / Unassigned'")} AS segment
FROM coded""")
def s5(spark, sf):
    sc = S.rfm_scores(rfm_base(spark, sf))
    return S.assign_segment(sc, S.APP_RULES, mode="last", match="prefix",
                            default=S.APP_DEFAULT).select("customer_id", "RFM_Score", "segment")


@register("s6_assign_segment_replace", f"""{SCORED_SQL}
SELECT customer_id, RFM_Score, {rules_case('RFM_Score', S.SCRIPT_RULES, 'first', 'search', 'RFM_Score')} AS segment
FROM coded""")
def s6(spark, sf):
    sc = S.rfm_scores(rfm_base(spark, sf))
    return S.assign_segment(sc, S.SCRIPT_RULES, match="search", default=None).select(
        "customer_id", "RFM_Score", "segment")


_CUSTOM = [{"pattern": "5[4-5][4-5]", "name": "Top"}, {"pattern": "[1-2].*", "name": "Cold", "enabled": False},
           {"pattern": "[1-3][1-5][1-5]", "name": "Cooling"}, {"pattern": "[4-5].*", "name": "Warm"}]


@register("s7_custom_segments", f"""{SCORED_SQL}
SELECT customer_id, RFM_Score, {rules_case('RFM_Score', S.custom_rules(_CUSTOM))} AS segment FROM coded""")
def s7(spark, sf):
    return rfm_quintiles(orders_clean(spark, sf), S.custom_rules(_CUSTOM)).select(
        "customer_id", "RFM_Score", "segment")


@register("s8_rfm_quintile_segments", f"SELECT * EXCLUDE (rn) FROM ({SEG_SQL} SELECT *, 0 AS rn FROM seg)", _R)
def s8(spark, sf):
    return segmented(spark, sf)


ABC_SQL = f"""{ORDERS_SQL}, rev AS (SELECT customer_id, sum(order_total) AS monetary FROM o GROUP BY 1),
cum AS (SELECT *, sum(monetary) OVER (ORDER BY monetary DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
        row_number() OVER (ORDER BY monetary DESC, customer_id) AS pos,
        sum(monetary) OVER () AS t FROM rev),
abc AS (SELECT customer_id, monetary, CASE WHEN t = 0 THEN 0.0 ELSE c / t END AS cumulative_pct,
        CASE WHEN t = 0 THEN 'C' WHEN (c - monetary) / t < 0.8 THEN 'A' WHEN (c - monetary) / t < 0.95 THEN 'B'
             ELSE 'C' END AS segment, pos FROM cum)"""


@register("s9_abc", f"{ABC_SQL} SELECT customer_id, monetary, cumulative_pct, segment FROM abc",
          {"monetary": MONEY, "cumulative_pct": RATIO})
def s9(spark, sf):
    return abc_method(orders_clean(spark, sf))


@register("s10_rename_segments", f"""{SEG_SQL}
SELECT customer_id, CASE segment WHEN 'Champions' THEN 'Best' WHEN 'Non Active' THEN 'Dormant' ELSE segment END AS segment
FROM seg""")
def s10(spark, sf):
    return S.rename_segments(segmented(spark, sf), {"Champions": "Best", "Non Active": "Dormant"}).select(
        "customer_id", "segment")


# ------------------------------------------------------------------ marts (H)

H1_SQL = f"""{SEG_SQL}, tot AS (SELECT count(*) AS n, sum(Monetary) AS rev FROM seg)
SELECT segment AS label, count(*) AS count, count(*) * 100.0 / any_value(n) AS pct_customers,
  avg(Recency) AS avg_recency, avg(Frequency) AS avg_frequency, avg(Monetary) AS avg_monetary,
  sum(Monetary) AS total_revenue,
  CASE WHEN any_value(rev) > 0 THEN sum(Monetary) * 100.0 / any_value(rev) ELSE 0.0 END AS pct_revenue
FROM seg, tot GROUP BY segment"""
H1_R = {"pct_customers": RATIO, "avg_recency": RATIO, "avg_frequency": RATIO, "avg_monetary": RATIO,
        "total_revenue": MONEY, "pct_revenue": RATIO}


@register("h1_segment_summary", H1_SQL, H1_R)
def h1(spark, sf):
    return H.segment_summary(segmented(spark, sf))


@register("h2_abc_summary", f"""{ABC_SQL}, tot AS (SELECT count(*) AS n, sum(monetary) AS rev FROM abc)
SELECT segment AS label, count(*) AS count, count(*) * 100.0 / any_value(n) AS pct_customers,
  avg(monetary) AS avg_monetary, sum(monetary) AS total_revenue,
  CASE WHEN any_value(rev) > 0 THEN sum(monetary) * 100.0 / any_value(rev) ELSE 0.0 END AS pct_revenue
FROM abc, tot GROUP BY segment""", {"pct_customers": RATIO, "avg_monetary": RATIO, "total_revenue": MONEY,
                                    "pct_revenue": RATIO})
def h2(spark, sf):
    return H.abc_summary(abc_method(orders_clean(spark, sf)))


@register("h4_score_means", f"""{SEG_SQL} SELECT segment AS label, avg(Recency_score) AS avg_r_score,
  avg(Frequency_score) AS avg_f_score, avg(Monetary_score) AS avg_m_score FROM seg GROUP BY 1""",
          {"avg_r_score": RATIO, "avg_f_score": RATIO, "avg_m_score": RATIO})
def h4(spark, sf):
    return H.score_means(segmented(spark, sf))


@register("h5_scatter_sample", f"""{SEG_SQL}, q AS (SELECT segment, count(*) AS ns, (SELECT count(*) FROM seg) AS n FROM seg GROUP BY 1),
r AS (SELECT seg.*, ns, n, row_number() OVER (PARTITION BY seg.segment ORDER BY md5('42:' || customer_id), customer_id) AS r
  FROM seg JOIN q USING (segment))
SELECT customer_id, Recency, Frequency, Monetary, segment FROM r
WHERE n <= 500 OR r <= greatest(1, floor(500 * ns / n))""", _R)
def h5(spark, sf):
    return H.scatter_sample(segmented(spark, sf), ["customer_id", "Recency", "Frequency", "Monetary", "segment"],
                            cap=500)


@register("h6_top10_per_segment", f"""{SEG_SQL} SELECT customer_id, Recency, Frequency, Monetary, segment,
  CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY Monetary DESC,
  customer_id) AS rank FROM seg) WHERE rank <= 10""", _R)
def h6(spark, sf):
    return H.top_per_segment(segmented(spark, sf), ["customer_id", "Recency", "Frequency", "Monetary", "segment"])


@register("h7_pareto_curve", f"""{ABC_SQL}, n AS (SELECT count(*) AS n FROM abc)
SELECT CAST(pos AS BIGINT) AS pos, round(pos * 100.0 / n * 100) / 100 AS x, round(cumulative_pct * 100.0 * 100) / 100 AS y, segment
FROM abc, n WHERE (pos - 1) % greatest(1, n // 300) = 0 OR pos = n""", {"x": 2, "y": 2})
def h7(spark, sf):
    return H.pareto_curve(abc_method_pos(spark, sf))


def abc_method_pos(spark, sf):
    from cohortkit.operators.scores import abc
    return abc(orders_clean(spark, sf), keep_pos=True)


@register("h8_abc_thresholds", f"""{ABC_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE segment = 'A') AS na,
  count(*) FILTER (WHERE segment = 'B') AS nb, max(cumulative_pct) FILTER (WHERE segment = 'A') AS ya,
  max(cumulative_pct) FILTER (WHERE segment = 'B') AS yb FROM abc)
SELECT round(na * 100.0 / n * 10) / 10 AS a_x, round((na + nb) * 100.0 / n * 10) / 10 AS b_x,
  coalesce(round(ya * 100 * 10) / 10, 0.0) AS a_y, coalesce(round(yb * 100 * 10) / 10, round(ya * 100 * 10) / 10, 0.0) AS b_y FROM s""",
          {"a_x": 1, "b_x": 1, "a_y": 1, "b_y": 1})
def h8(spark, sf):
    return H.abc_thresholds(abc_method(orders_clean(spark, sf)))


def _stats_sql(src, metrics):
    parts = []
    for name, c in metrics.items():
        parts += [f"avg({c}) AS {name}_mean", f"stddev_samp({c}) AS {name}_std",
                  f"CAST(min({c}) AS DOUBLE) AS {name}_min", f"CAST(max({c}) AS DOUBLE) AS {name}_max"]
    return f"SELECT segment, {', '.join(parts)} FROM {src} GROUP BY segment"


_RFM3 = {"recency": "Recency", "frequency": "Frequency", "monetary": "Monetary"}


@register("h9_cluster_stats", f"{SEG_SQL} {_stats_sql('seg', _RFM3)}",
          {f"{m}_{s}": (MONEY if m == "monetary" and s in ("min", "max") else RATIO) for m in _RFM3 for s in
           ("mean", "std", "min", "max")})
def h9(spark, sf):
    return H.cluster_stats(segmented(spark, sf), _RFM3)


@register("h10_detect_quantiles", f"{SEG_SQL} SELECT CAST(max(Recency_score) AS INTEGER) AS n_quantiles FROM seg")
def h10(spark, sf):
    return H.detect_quantiles(segmented(spark, sf))


H1_CTE = f"h AS ({H1_SQL})"


@register("h11_profile_minmax", f"""WITH {H1_CTE}
SELECT *, CASE WHEN max(avg_recency) OVER () = min(avg_recency) OVER () THEN 0.5
  ELSE (avg_recency - min(avg_recency) OVER ()) / (max(avg_recency) OVER () - min(avg_recency) OVER ()) END AS avg_recency_norm,
  CASE WHEN max(avg_monetary) OVER () = min(avg_monetary) OVER () THEN 0.5
  ELSE (avg_monetary - min(avg_monetary) OVER ()) / (max(avg_monetary) OVER () - min(avg_monetary) OVER ()) END AS avg_monetary_norm
FROM h""", {**H1_R, "avg_recency_norm": RATIO, "avg_monetary_norm": RATIO})
def h11(spark, sf):
    return H.profile_minmax(H.segment_summary(segmented(spark, sf)), ["avg_recency", "avg_monetary"])


@register("h12_profile_pct_of_max", f"""WITH {H1_CTE}
SELECT *, CASE WHEN max(avg_frequency) OVER () = 0 THEN 0.0 ELSE avg_frequency * 100.0 / max(avg_frequency) OVER () END
  AS avg_frequency_pct FROM h""", {**H1_R, "avg_frequency_pct": RATIO})
def h12(spark, sf):
    return H.profile_pct_of_max(H.segment_summary(segmented(spark, sf)), ["avg_frequency"])


@register("h13_revenue_share", f"WITH {H1_CTE} SELECT label, pct_customers, pct_revenue, total_revenue FROM h",
          {"pct_customers": RATIO, "pct_revenue": RATIO, "total_revenue": MONEY})
def h13(spark, sf):
    return H.revenue_share(H.segment_summary(segmented(spark, sf)))


@register("h14_bubble", f"WITH {H1_CTE} SELECT label, avg_recency, avg_monetary, count, avg_frequency FROM h",
          {"avg_recency": RATIO, "avg_monetary": RATIO, "avg_frequency": RATIO})
def h14(spark, sf):
    return H.bubble(H.segment_summary(segmented(spark, sf)))


@register("h15_cluster_profile", f"""{SEG_SQL}, n AS (SELECT count(*) AS n FROM seg)
SELECT segment, avg(Recency) AS Recency, avg(Frequency) AS Frequency, avg(Monetary) AS Monetary,
  sum(Monetary) AS Monetary_sum, sum(Frequency) AS Frequency_sum, count(*) AS count,
  count(*) * 100.0 / any_value(n) AS pct FROM seg, n GROUP BY segment""",
          {"Recency": RATIO, "Frequency": RATIO, "Monetary": RATIO, "Monetary_sum": MONEY, "pct": RATIO,
           "Frequency_sum": 0})
def h15(spark, sf):
    return H.cluster_profile(segmented(spark, sf), "segment", ["Recency", "Frequency", "Monetary"],
                             ["Monetary", "Frequency"])


@register("h16_run_kpis", f"""{SEG_SQL}, k AS (SELECT CAST(count(*) AS DOUBLE) AS total_customers,
  CAST(count(DISTINCT segment) AS DOUBLE) AS clusters, avg(Recency) AS mean_recency, avg(Monetary) AS mean_monetary,
  5.0 AS n_quantiles FROM seg)
SELECT 'total_customers' AS metric, total_customers AS value FROM k UNION ALL SELECT 'clusters', clusters FROM k
UNION ALL SELECT 'mean_recency', mean_recency FROM k UNION ALL SELECT 'mean_monetary', mean_monetary FROM k
UNION ALL SELECT 'n_quantiles', n_quantiles FROM k""", {"value": 4})
def h16(spark, sf):
    return H.run_kpis(segmented(spark, sf), extra={"n_quantiles": 5})


@register("h18_segment_counts_share", f"""{SEG_SQL}, n AS (SELECT count(*) AS n FROM seg)
SELECT segment AS label, count(*) AS count, count(*) * 100.0 / any_value(n) AS pct FROM seg, n GROUP BY 1""",
          {"pct": RATIO})
def h18(spark, sf):
    return H.segment_counts_share(segmented(spark, sf))


@register("h19_boxplot_stats", f"""{SEG_SQL} SELECT segment, CAST(min(Monetary) AS DOUBLE) AS min,
  quantile_cont(Monetary, 0.25) AS q1, quantile_cont(Monetary, 0.5) AS median, quantile_cont(Monetary, 0.75) AS q3,
  CAST(max(Monetary) AS DOUBLE) AS max FROM seg GROUP BY segment""",
          {"min": MONEY, "q1": 4, "median": 4, "q3": 4, "max": MONEY})
def h19(spark, sf):
    return H.boxplot_stats(segmented(spark, sf), "Monetary")


@register("s11_cluster_type", f"""{LRFM_SQL}, g AS (SELECT CAST(customer_id AS BIGINT) % 8 AS segment, L, R, M FROM lrfm
  UNION ALL SELECT 10 + CASE WHEN L < qL THEN 0 ELSE 1 END + 2 * CASE WHEN R < qR THEN 0 ELSE 1 END
    + 4 * CASE WHEN M > qM THEN 1 ELSE 0 END, L, R, M FROM lrfm, (SELECT median(L) qL, median(R) qR, median(M) qM FROM lrfm)),
prof AS (SELECT segment, avg(L) AS L, avg(R) AS R, avg(M) AS M FROM g GROUP BY 1),
med AS (SELECT quantile_cont(L, 0.5) AS ml, quantile_cont(R, 0.5) AS mr, quantile_cont(M, 0.5) AS mm FROM lrfm)
SELECT segment, L, R, M, CASE WHEN L < ml THEN CASE WHEN R < mr THEN 'CLIENTES NUEVOS ACTIVOS' ELSE 'CLIENTES NUEVOS INACTIVOS' END
  ELSE CASE WHEN R < mr THEN CASE WHEN M > mm THEN 'CLIENTES VIP/LEALES' ELSE 'CLIENTES LEALES' END
  ELSE 'CLIENTES EN RIESGO' END END AS cluster_type FROM prof, med""", {"L": RATIO, "R": RATIO, "M": RATIO})
def s11(spark, sf):
    """Groups by id, and groups by the side of each median, which reach all five names."""
    lr = A.lrfm_static(orders_clean(spark, sf)).transform(cut)
    med = exact_quantiles(lr, "L", [0.5], "l").crossJoin(exact_quantiles(lr, "R", [0.5], "r")).crossJoin(
        exact_quantiles(lr, "M", [0.5], "m"))
    side = (F.lit(10) + F.when(F.col("L") < F.col("l0"), 0).otherwise(1) + 2 * F.when(F.col("R") < F.col("r0"), 0).otherwise(1)
            + 4 * F.when(F.col("M") > F.col("m0"), 1).otherwise(0))
    g = lr.select((F.col("customer_id").cast("bigint") % 8).alias("segment"), "L", "R", "M").unionAll(
        lr.crossJoin(F.broadcast(med)).select(side.cast("bigint").alias("segment"), "L", "R", "M"))  # one row of medians
    prof = g.groupBy("segment").agg(*[F.avg(c).alias(c) for c in ("L", "R", "M")])
    return S.cluster_type(prof, lr)
