"""Registered queries: scaling, cluster metrics, K-Means, DBSCAN, pairs and
density peaks (F, J7-J9, T10, T17-T23, H3, H17)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cohortkit.operators import cluster_metrics as CM
from cohortkit.operators import density as D
from cohortkit.operators import marts as H
from cohortkit.operators import orders as A
from cohortkit.operators import scaling as SC
from cohortkit.operators import landmarks as LM
from cohortkit.operators import pairs as PR
from cohortkit.operators import peaks as PK
from cohortkit.operators import warping as WP
from cohortkit.operators.kmeans import assign, evaluate_k_range, fit_best, lloyd_steps, pca2, silhouette
from cohortkit.operators.dbscan import dbscan
from cohortkit.plans import flows
from cohortkit.plans.q_base import LRFM_SQL, MONEY, RATIO, RFM_SQL, orders_clean, rfm_base
from cohortkit.plans.q_series import LONG_SQL, returns_orders
from cohortkit.plans.registry import register
from cohortkit.sources import testdata as td
from cohortkit.session import cut

RFM3 = ["Recency", "Frequency", "Monetary"]
KS = [2, 3, 4]

SCALED_SQL = f"""{RFM_SQL}, st AS (SELECT avg(Recency) mr, stddev_pop(Recency) sr, avg(Frequency) mf,
  stddev_pop(Frequency) sf, avg(Monetary) mm, stddev_pop(Monetary) sm FROM rfm),
sc AS (SELECT customer_id, CASE WHEN sr = 0 THEN 0.0 ELSE (Recency - mr) / sr END AS Recency,
  CASE WHEN sf = 0 THEN 0.0 ELSE (Frequency - mf) / sf END AS Frequency,
  CASE WHEN sm = 0 THEN 0.0 ELSE (Monetary - mm) / sm END AS Monetary FROM rfm, st)"""
_R6 = {c: RATIO for c in RFM3}


def scaled(spark, sf):
    return SC.standard_scale(A.rfm(orders_clean(spark, sf), once=True), RFM3)


def stand_in(df, ks=KS):
    return df.withColumns({f"label_k{k}": (F.col("customer_id").cast("bigint") % k).cast("int") for k in ks})


LAB_SQL = f"""{SCALED_SQL}, lab AS (SELECT k, customer_id, CAST(CAST(customer_id AS BIGINT) % k AS INTEGER) AS label,
  Recency, Frequency, Monetary FROM sc, (VALUES {', '.join(f'({k})' for k in KS)}) t(k))"""


@register("f1_standard_scale", f"{SCALED_SQL} SELECT * FROM sc", _R6)
def f1(spark, sf):
    return scaled(spark, sf)


@register("f3_log_features", f"""{LRFM_SQL} SELECT customer_id, L, R, ln(1 + F) AS F, ln(1 + M) AS M FROM lrfm""",
          {"R": RATIO, "F": RATIO, "M": RATIO})
def f3(spark, sf):
    return SC.log_features(A.lrfm_static(orders_clean(spark, sf)), ["F", "M"])


@register("f4_winsorize_p99", f"""{LRFM_SQL} SELECT customer_id, least(L, qL) AS L, least(R, qR) AS R,
  least(F, qF) AS F, least(M, qM) AS M FROM lrfm, (SELECT quantile_cont(L, 0.99) qL, quantile_cont(R, 0.99) qR,
  quantile_cont(F, 0.99) qF, quantile_cont(M, 0.99) qM FROM lrfm)""", {"L": 4, "R": 4, "F": 4, "M": MONEY})
def f4(spark, sf):
    return SC.winsorize(A.lrfm_static(orders_clean(spark, sf)), ["L", "R", "F", "M"], 0.99)


_W_SQL = """SELECT {cols} FROM (SELECT {vars} FROM {src}), (SELECT {tot} AS tv FROM (SELECT {vars} FROM {src}))"""


def _wsql(src, cols, agg):
    v = ", ".join(f"{agg.format(c=c)} AS v_{c}" for c in cols)
    tot = " + ".join(f"v_{c}" for c in cols)
    out = ", ".join(f"CASE WHEN tv > 0 THEN v_{c} / tv ELSE {1.0 / len(cols)} END AS w_{c}" for c in cols)
    return _W_SQL.format(cols=out, vars=v, src=src, tot=tot)


@register("f5_variance_weights", f"{LRFM_SQL} {_wsql('lrfm', ['L', 'R', 'F', 'M'], 'var_pop({c})')}",
          {f"w_{c}": RATIO for c in "LRFM"})
def f5(spark, sf):
    return SC.variance_weights(A.lrfm_static(orders_clean(spark, sf)), ["L", "R", "F", "M"])


@register("f6_deviation_weights", f"""{LRFM_SQL}, mu AS (SELECT avg(L) mL, avg(R) mR, avg(F) mF, avg(M) mM FROM lrfm),
dv AS (SELECT sum(abs(L - mL)) dL, sum(abs(R - mR)) dR, sum(abs(F - mF)) dF, sum(abs(M - mM)) dM FROM lrfm, mu)
SELECT dL / (dL + dR + dF + dM) AS w_L, dR / (dL + dR + dF + dM) AS w_R, dF / (dL + dR + dF + dM) AS w_F,
  dM / (dL + dR + dF + dM) AS w_M FROM dv""", {f"w_{c}": RATIO for c in "LRFM"})
def f6(spark, sf):
    return SC.deviation_weights(A.lrfm_static(orders_clean(spark, sf)), ["L", "R", "F", "M"])


@register("f7_apply_weights", f"""{LRFM_SQL}, w AS ({_wsql('lrfm', ['L', 'R', 'F', 'M'], 'var_pop({c})')})
SELECT customer_id, L * w_L AS L, R * w_R AS R, F * w_F AS F, M * w_M AS M FROM lrfm, w""",
          {"L": RATIO, "R": RATIO, "F": RATIO, "M": 2})
def f7(spark, sf):
    lr = A.lrfm_static(orders_clean(spark, sf))
    return SC.apply_weights(lr, ["L", "R", "F", "M"], SC.variance_weights(lr, ["L", "R", "F", "M"]))


METRICS_SQL = f"""{LAB_SQL},
cen AS (SELECT k, label, count(*) n, avg(Recency) cR, avg(Frequency) cF, avg(Monetary) cM FROM lab GROUP BY 1, 2),
jn AS (SELECT lab.k, lab.label, pow(Recency - cR, 2) + pow(Frequency - cF, 2) + pow(Monetary - cM, 2) AS d2
       FROM lab JOIN cen USING (k, label)),
per AS (SELECT jn.k, jn.label, sum(d2) ss, avg(sqrt(d2)) scatter, any_value(n) n, any_value(cR) cR, any_value(cF) cF,
        any_value(cM) cM FROM jn JOIN cen USING (k, label) GROUP BY 1, 2),
db AS (SELECT k, avg(r) AS davies_bouldin FROM (SELECT a.k, a.label, max(CASE WHEN sqrt(pow(a.cR - b.cR, 2)
       + pow(a.cF - b.cF, 2) + pow(a.cM - b.cM, 2)) = 0 THEN 0.0 ELSE (a.scatter + b.scatter) / sqrt(pow(a.cR - b.cR, 2)
       + pow(a.cF - b.cF, 2) + pow(a.cM - b.cM, 2)) END) r FROM per a JOIN per b ON a.k = b.k AND a.label <> b.label
       GROUP BY 1, 2) GROUP BY 1),
mean AS (SELECT k, count(*) NN, avg(Recency) mR, avg(Frequency) mF, avg(Monetary) mM FROM lab GROUP BY 1),
ch AS (SELECT per.k, sum(ss) wcss, sum(n * (pow(cR - mR, 2) + pow(cF - mF, 2) + pow(cM - mM, 2))) bb,
       any_value(NN) NN, count(*) nk FROM per JOIN mean USING (k) GROUP BY 1),
metrics AS (SELECT k, wcss, coalesce(davies_bouldin, 0.0) AS davies_bouldin,
  CASE WHEN wcss = 0 THEN 1.0 ELSE bb * (NN - nk) / (wcss * (nk - 1)) END AS calinski_harabasz FROM ch LEFT JOIN db USING (k))"""
_M = {"wcss": 4, "davies_bouldin": RATIO, "calinski_harabasz": 4}


def stand_in_metrics(spark, sf):
    return CM.label_metrics(stand_in(scaled(spark, sf)), RFM3, {k: f"label_k{k}" for k in KS})


@register("f9_f11_f12_label_metrics", f"{METRICS_SQL} SELECT * FROM metrics", _M)
def f9(spark, sf):
    return stand_in_metrics(spark, sf)


SIL_SQL = f"""{LAB_SQL},
pr AS (SELECT a.customer_id i, b.customer_id j, sqrt(pow(a.Recency - b.Recency, 2) + pow(a.Frequency - b.Frequency, 2)
       + pow(a.Monetary - b.Monetary, 2)) d FROM sc a, sc b WHERE a.customer_id <> b.customer_id),
sz AS (SELECT k, label, count(*) n FROM lab GROUP BY 1, 2),
sums AS (SELECT la.k, pr.i, lb.label, sum(d) s FROM pr JOIN lab la ON la.customer_id = pr.i
         JOIN lab lb ON lb.customer_id = pr.j AND lb.k = la.k GROUP BY 1, 2, 3),
ab AS (SELECT la.k, la.customer_id i, any_value(o.n) n,
       coalesce(max(s.s) FILTER (WHERE s.label = la.label), 0.0) / greatest(any_value(o.n) - 1, 1) a,
       min(s.s / z.n) FILTER (WHERE s.label <> la.label) b
       FROM lab la JOIN sz o ON o.k = la.k AND o.label = la.label JOIN sums s ON s.k = la.k AND s.i = la.customer_id
       JOIN sz z ON z.k = s.k AND z.label = s.label GROUP BY 1, 2),
sil AS (SELECT k, avg(CASE WHEN n > 1 AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0.0 END) AS silhouette
        FROM ab GROUP BY k)"""


def stand_in_sil(spark, sf):
    return silhouette(stand_in(scaled(spark, sf)), RFM3, {k: f"label_k{k}" for k in KS})


@register("f10_silhouette_euclid", f"{SIL_SQL} SELECT * FROM sil", {"silhouette": RATIO})
def f10(spark, sf):
    return stand_in_sil(spark, sf).drop("bound")


COMB_SQL = METRICS_SQL + "," + SIL_SQL.split(", lab AS (", 1)[1].split("),\npr AS", 1)[1].join(["\npr AS", ""]) + """,
sc2 AS (SELECT * FROM metrics JOIN sil USING (k)),
scores AS (SELECT *, 0.4 * (CASE WHEN max(silhouette) OVER () = min(silhouette) OVER () THEN 1.0 ELSE (silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER ()) END)
  + 0.3 * (1 - CASE WHEN max(davies_bouldin) OVER () = min(davies_bouldin) OVER () THEN 1.0 ELSE (davies_bouldin - min(davies_bouldin) OVER ()) / (max(davies_bouldin) OVER () - min(davies_bouldin) OVER ()) END)
  + 0.3 * (CASE WHEN max(calinski_harabasz) OVER () = min(calinski_harabasz) OVER () THEN 1.0 ELSE (calinski_harabasz - min(calinski_harabasz) OVER ()) / (max(calinski_harabasz) OVER () - min(calinski_harabasz) OVER ()) END) AS combined
  FROM sc2)"""


def stand_in_scores(spark, sf):
    return CM.combined_score(stand_in_metrics(spark, sf).join(stand_in_sil(spark, sf).drop("bound"), "k"))


@register("f14_combined_score", f"{COMB_SQL} SELECT * FROM scores", {**_M, "silhouette": RATIO, "combined": RATIO})
def f14(spark, sf):
    return stand_in_scores(spark, sf)


@register("f15_select_k", f"""{COMB_SQL}
SELECT 'combined' AS method, arg_max(k, combined * 1e6 - k) AS k FROM scores
UNION ALL SELECT 'silhouette', arg_max(k, silhouette * 1e6 - k) FROM scores
UNION ALL SELECT 'davies_bouldin', arg_min(k, davies_bouldin * 1e6 + k) FROM scores
UNION ALL SELECT 'elbow', (SELECT k FROM (SELECT k, lead(wcss) OVER (ORDER BY k) - 2 * wcss + lag(wcss) OVER (ORDER BY k) AS v
  FROM scores) WHERE v IS NOT NULL ORDER BY v DESC, k LIMIT 1)""")
def f15(spark, sf):
    s = stand_in_scores(spark, sf).transform(cut)
    parts = [CM.select_k(s, m).select(F.lit(m).alias("method"), F.col("k").cast("int").alias("k"))
             for m in ["combined", "silhouette", "davies_bouldin", "elbow"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("h17_normalised_wcss", f"""{METRICS_SQL} SELECT k, wcss, CASE WHEN max(wcss) OVER () = min(wcss) OVER () THEN 1.0
  ELSE (wcss - min(wcss) OVER ()) / (max(wcss) OVER () - min(wcss) OVER ()) END AS wcss_norm FROM metrics""",
          {"wcss": 4, "wcss_norm": RATIO})
def h17(spark, sf):
    return H.normalised_wcss(stand_in_metrics(spark, sf))


@register("f19_cluster_centers", f"""{LAB_SQL} SELECT k, label, count(*) AS n, avg(Recency) AS c_Recency,
  avg(Frequency) AS c_Frequency, avg(Monetary) AS c_Monetary FROM lab GROUP BY 1, 2""",
          {"c_Recency": RATIO, "c_Frequency": RATIO, "c_Monetary": RATIO})
def f19(spark, sf):
    s = stand_in(scaled(spark, sf))
    parts = [CM.centers(s.withColumn("label", F.col(f"label_k{k}")), RFM3).select(F.lit(k).alias("k"), "*")
             for k in KS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------- model-based (ROWS)

@register("f8_kmeans")
def f8(spark, sf):
    data = scaled(spark, sf).select("customer_id", *RFM3)
    _cost, _seed, centres = fit_best(data, 4, n_init=10, feats=RFM3)
    return assign(data, RFM3, centres, "cluster").select("customer_id", "cluster")


START = [(0.0, 0.0, 0.0), (1.0, 0.5, 0.5), (-0.5, -1.0, -1.0)]


def _lloyd_sql(steps):
    out = f"{SCALED_SQL}, s0(c, r, f, m) AS (VALUES {', '.join(f'({i}, {r}, {f}, {m})' for i, (r, f, m) in enumerate(START))})"
    for i in range(steps + 1):
        out += f""", a{i} AS (SELECT customer_id, any_value(Recency) AS r, any_value(Frequency) AS f, any_value(Monetary) AS m,
  arg_min(c, d) AS c, min(d) AS d FROM (SELECT sc.*, c, pow(Recency - r, 2) + pow(Frequency - f, 2) + pow(Monetary - m, 2) AS d
  FROM sc, s{i}) GROUP BY customer_id)"""
        if i < steps:
            out += f""", s{i + 1} AS (SELECT s{i}.c, coalesce(avg(a{i}.r), any_value(s{i}.r)) AS r, coalesce(avg(a{i}.f), any_value(s{i}.f)) AS f,
  coalesce(avg(a{i}.m), any_value(s{i}.m)) AS m FROM s{i} LEFT JOIN a{i} USING (c) GROUP BY s{i}.c)"""
    return out + f" SELECT customer_id, CAST(c AS INTEGER) AS cluster, d AS cost FROM a{steps}"


@register("f8b_kmeans_given_start", _lloyd_sql(3), {"cost": RATIO})
def f8_given_start(spark, sf):
    return lloyd_steps(scaled(spark, sf).select("customer_id", *RFM3), RFM3, START, 3)


@register("f13_evaluate_k_range")
def f13(spark, sf):
    scores, _, _ = evaluate_k_range(scaled(spark, sf), RFM3, 2, 10, n_init=10)
    return scores


@register("f23_rfm_cluster_segments")
def f23(spark, sf):
    res, _ = flows.rfm_clusters(orders_clean(spark, sf))
    return res


# pairs within eps, core points, cells of side eps / sqrt(3) that hold a link between core points, components of cells
DBSCAN_SQL = SCALED_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
pt AS (SELECT *, floor(Recency / (0.5 / sqrt(3))) || ',' || floor(Frequency / (0.5 / sqrt(3))) || ',' || floor(Monetary / (0.5 / sqrt(3))) AS cell
  FROM sc),
nb AS (SELECT a.customer_id AS i, b.customer_id AS j, a.cell AS ci, b.cell AS cj FROM pt a JOIN pt b
  ON pow(a.Recency - b.Recency, 2) + pow(a.Frequency - b.Frequency, 2) + pow(a.Monetary - b.Monetary, 2) <= 0.25),
core AS (SELECT i AS id, any_value(ci) AS cell FROM nb GROUP BY 1 HAVING count(*) >= 5),
link AS (SELECT DISTINCT ci AS u, cj AS v FROM nb JOIN core a ON a.id = i JOIN core b ON b.id = j),
reach(u, v) AS (SELECT DISTINCT cell, cell FROM core UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v),
lab AS (SELECT u AS cell, min(id) AS lab FROM reach JOIN core ON core.cell = reach.v GROUP BY 1),
num AS (SELECT lab, row_number() OVER (ORDER BY lab) - 1 AS k FROM (SELECT DISTINCT lab FROM lab)),
own AS (SELECT i AS id, min(lab) AS lab FROM nb JOIN core ON core.id = j JOIN lab ON lab.cell = core.cell
  WHERE i = j OR i NOT IN (SELECT id FROM core) GROUP BY 1),
seg AS (SELECT pt.customer_id, coalesce('Cluster ' || k::VARCHAR, 'Noise') AS segment, core.id IS NOT NULL AS is_core
  FROM pt LEFT JOIN own ON own.id = pt.customer_id LEFT JOIN num USING (lab) LEFT JOIN core ON core.id = pt.customer_id)"""


@register("f17_dbscan", f"{DBSCAN_SQL} SELECT * FROM seg")
def f17(spark, sf):
    return dbscan(scaled(spark, sf), RFM3, eps=0.5, min_samples=5)


@register("f23b_rfm_dbscan_segments", f"{DBSCAN_SQL} SELECT rfm.*, segment FROM rfm JOIN seg USING (customer_id)", {"Monetary": MONEY})
def f23b(spark, sf):
    res, _ = flows.rfm_clusters(orders_clean(spark, sf), algorithm="dbscan")
    return res


@register("f23c_dbscan_figures", f"""{DBSCAN_SQL} SELECT 'dbscan' AS algorithm, CAST(n AS BIGINT) AS optimal_k, CAST(n AS BIGINT) AS n_clusters, noise_points
FROM (SELECT count(DISTINCT segment) FILTER (WHERE segment <> 'Noise') AS n, count(*) FILTER (WHERE segment = 'Noise') AS noise_points FROM seg)""")
def f23c(spark, sf):
    _, figures = flows.rfm_clusters(orders_clean(spark, sf), algorithm="dbscan")
    return flows.run_figures(spark, figures).select(
        "algorithm", *[F.col(c).cast("bigint").alias(c) for c in ("optimal_k", "n_clusters", "noise_points")])


@register("f23d_rfm_cluster_figures")
def f23d(spark, sf):
    _, figures = flows.rfm_clusters(orders_clean(spark, sf))
    return flows.run_figures(spark, figures)


_CELLS = ("rr", "rf", "rm", "ff", "fm", "mm")  # of a symmetric matrix


def _axis_sql(name, matrix):
    """CTEs for the main axis of a covariance matrix: its 2^40th power is, but for the scale, the axis times itself."""
    squared = {"rr": "rr*rr+rf*rf+rm*rm", "rf": "rr*rf+rf*ff+rm*fm", "rm": "rr*rm+rf*fm+rm*mm",
               "ff": "rf*rf+ff*ff+fm*fm", "fm": "rf*rm+ff*fm+fm*mm", "mm": "rm*rm+fm*fm+mm*mm"}
    columns = ", ".join(_CELLS)
    return f"""{name}_p(i, {columns}) AS (SELECT 0, {", ".join(f"{c}/(rr+ff+mm)" for c in _CELLS)} FROM {matrix}
  UNION ALL SELECT i + 1, {", ".join(f"({e})/t" for e in squared.values())}
  FROM (SELECT *, {squared["rr"]}+{squared["ff"]}+{squared["mm"]} AS t FROM {name}_p WHERE i < 40)),
{name}_c AS (SELECT CASE WHEN rr >= ff AND rr >= mm THEN rr WHEN ff >= mm THEN rf ELSE rm END AS r,
  CASE WHEN rr >= ff AND rr >= mm THEN rf WHEN ff >= mm THEN ff ELSE fm END AS f,
  CASE WHEN rr >= ff AND rr >= mm THEN rm WHEN ff >= mm THEN fm ELSE mm END AS m FROM {name}_p WHERE i = 40),
{name} AS (SELECT r/n AS r, f/n AS f, m/n AS m FROM (SELECT *, sqrt(r*r+f*f+m*m) AS n FROM {name}_c)),
{name}_v AS (SELECT rr*r*r+ff*f*f+mm*m*m+2*(rf*r*f+rm*r*m+fm*f*m) AS v FROM {matrix}, {name})"""


@register("f18_pca2", SCALED_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
mu AS (SELECT avg(Recency) AS r0, avg(Frequency) AS f0, avg(Monetary) AS m0 FROM sc),
ce AS (SELECT customer_id, Recency - r0 AS x, Frequency - f0 AS y, Monetary - m0 AS z FROM sc, mu),
cov AS (SELECT avg(x*x) AS rr, avg(x*y) AS rf, avg(x*z) AS rm, avg(y*y) AS ff, avg(y*z) AS fm, avg(z*z) AS mm FROM ce),
{_axis_sql("one", "cov")},
rest AS (SELECT rr-v*r*r AS rr, rf-v*r*f AS rf, rm-v*r*m AS rm, ff-v*f*f AS ff, fm-v*f*m AS fm, mm-v*m*m AS mm FROM cov, one, one_v),
{_axis_sql("two", "rest")}
SELECT customer_id, x*one.r + y*one.f + z*one.m AS pc1, x*two.r + y*two.f + z*two.m AS pc2,
       one_v.v/(rr+ff+mm) AS explained_1, two_v.v/(rr+ff+mm) AS explained_2 FROM ce, one, two, one_v, two_v, cov""",
          {"pc1": RATIO, "pc2": RATIO, "explained_1": RATIO, "explained_2": RATIO})
def f18(spark, sf):
    return pca2(scaled(spark, sf), RFM3)


@register("t10_lrfms_segments")
def t10(spark, sf):
    res, _ = flows.lrfms(returns_orders(spark, sf), n_intervals=4, s_weight=1.0)
    return res


@register("t10b_lrfms_figures")
def t10b(spark, sf):
    _, figures = flows.lrfms(returns_orders(spark, sf), n_intervals=4, s_weight=1.0)
    return flows.run_figures(spark, figures)


@register("h3_lrfms_summary", None)
def h3(spark, sf):
    res, _ = flows.lrfms(returns_orders(spark, sf), n_intervals=4, s_weight=1.0)
    return H.lrfms_summary(res)


# ------------------------------------------------- pairs on embeddings (SQL)

def emb(spark, sf):
    return td.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


EMB_PAIRS = """ep AS (SELECT CAST(a.vec_id AS VARCHAR) AS i, CAST(b.vec_id AS VARCHAR) AS j,
  list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist
  FROM embeddings a, embeddings b WHERE CAST(a.vec_id AS VARCHAR) < CAST(b.vec_id AS VARCHAR))"""


def emb_pairs(spark, sf, distance=PR.euclid):
    e = emb(spark, sf).select("id", "x")
    return PR.pair_distances(e, e.count(), distance)


@register("t17_pair_distances", f"WITH {EMB_PAIRS} SELECT * FROM ep", {"dist": RATIO})
def t17(spark, sf):
    return emb_pairs(spark, sf)


@register("j9_all_pairs", f"WITH {EMB_PAIRS} SELECT i, j FROM ep")
def j9(spark, sf):
    return emb_pairs(spark, sf).select("i", "j")


@register("t19_cid_distance", """WITH ce AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS x,
  sqrt(list_sum(list_transform(range(1, len(embedding)), lambda p: pow(CAST(embedding[p + 1] AS DOUBLE) - CAST(embedding[p] AS DOUBLE), 2)))) AS c
  FROM embeddings)
SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) * greatest(a.c, b.c) / (least(a.c, b.c) + 1e-9) AS dist
FROM ce a, ce b WHERE a.id < b.id""", {"dist": RATIO})
def t19(spark, sf):
    return emb_pairs(spark, sf, PR.complexity_invariant)


PEAKS_SQL = f"""{SCALED_SQL}, z AS (SELECT customer_id, round(Recency, 6) AS x, round(Frequency, 6) AS y, round(Monetary, 6) AS w FROM sc),
smp AS (SELECT * FROM z ORDER BY md5('42:' || customer_id), customer_id LIMIT 200),
dcv AS (SELECT greatest(floor(quantile_cont(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.w - b.w, 2)), 0.02) * 1000 + 0.5) / 1000,
  0.001) AS dc FROM smp a, smp b),
cells AS (SELECT floor(x / dc) AS g0, floor(y / dc) AS g1, floor(w / dc) AS g2, count(*) AS n, min(customer_id) AS id, avg(x) AS x,
  avg(y) AS y, avg(w) AS w, any_value(dc) AS dc FROM z, dcv GROUP BY 1, 2, 3),
pr AS (SELECT a.id AS i, b.id AS j, b.n, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.w - b.w, 2)) AS d, a.dc FROM cells a, cells b),
rho AS (SELECT i AS id, round(sum(n * exp(-pow(d / dc, 2))), 6) AS rho FROM pr WHERE d <= 3 * dc GROUP BY 1),
dl AS (SELECT pr.i AS id, min(d) AS delta FROM pr JOIN rho a ON a.id = pr.i JOIN rho b ON b.id = pr.j
  WHERE b.rho > a.rho OR (b.rho = a.rho AND pr.j < pr.i) GROUP BY 1),
pk AS (SELECT z.customer_id AS id, rho.rho, CASE WHEN z.customer_id <> cells.id THEN 0.0
  ELSE coalesce(dl.delta, (SELECT coalesce(max(delta), 0.0) FROM dl)) END AS delta
  FROM z, dcv, cells JOIN rho USING (id) LEFT JOIN dl USING (id)
  WHERE floor(z.x / dcv.dc) = g0 AND floor(z.y / dcv.dc) = g1 AND floor(z.w / dcv.dc) = g2),
pk2 AS (SELECT *, rho * delta AS gamma FROM pk),
ranked AS (SELECT id, CAST(row_number() OVER (ORDER BY gamma DESC, id) AS INTEGER) AS center_rank FROM pk2 ORDER BY gamma DESC, id LIMIT 4)"""


def rounded(spark, sf):
    return scaled(spark, sf).select("customer_id", *[F.round(c, 6).alias(c) for c in RFM3]).transform(cut)


@register("f20_density_peaks", f"{PEAKS_SQL} SELECT pk2.*, ranked.center_rank FROM pk2 LEFT JOIN ranked USING (id)",
          {"rho": RATIO, "delta": RATIO, "gamma": 4})
def f20(spark, sf):
    return PK.density_peaks(rounded(spark, sf), RFM3, 4)


@register("j8_higher_density_min", f"{PEAKS_SQL} SELECT id, delta FROM pk", {"delta": RATIO})
def j8(spark, sf):
    return PK.density_peaks(rounded(spark, sf), RFM3, 4).select("id", "delta")


@register("f21_fuzzy_membership", f"""{PEAKS_SQL}, cd AS (SELECT a.customer_id AS id, r.center_rank,
  sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.w - b.w, 2)) AS dist FROM z a, ranked r JOIN z b ON b.customer_id = r.id)
SELECT id, center_rank, pow(1.0 / (dist + 1e-9), 0.5) / sum(pow(1.0 / (dist + 1e-9), 0.5)) OVER (PARTITION BY id) AS membership
FROM cd""", {"membership": RATIO})
def f21(spark, sf):
    z = rounded(spark, sf)
    return PK.fuzzy_membership(z, RFM3, PK.density_peaks(z, RFM3, 4))


@register("t22_sample_customers", f"{RFM_SQL} SELECT * FROM rfm ORDER BY md5('42:' || customer_id), customer_id LIMIT 100",
          {"Monetary": MONEY})
def t22(spark, sf):
    return D.sample_customers(rfm_base(spark, sf), 100)


# within-cluster squared distances and sizes of the labelled vectors, dimension by dimension
@register("f9b_embedding_label_metrics", """WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v,
  generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS c FROM x GROUP BY 1, 2)
SELECT x.label, count(DISTINCT vec_id) AS n, sum((v - c) * (v - c)) AS wcss FROM x JOIN m USING (label, i) GROUP BY 1""",
          {"wcss": 4})
def f9b(spark, sf):
    e = td.table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    e = e.withColumn("v", F.col("v").cast("double"))
    # sum (v - mean)^2 per label: one aggregate, no join back
    per = e.groupBy("label", "i").agg(F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("var"))
    return per.groupBy("label").agg(F.max("n").alias("n"), F.sum(F.col("n") * F.col("var")).alias("wcss"))


@register("f10b_silhouette_squared", f"""{LAB_SQL},
sst AS (SELECT k, label, count(*) n, sum(Recency) sR, sum(Frequency) sF, sum(Monetary) sM,
  sum(Recency * Recency + Frequency * Frequency + Monetary * Monetary) s2 FROM lab GROUP BY 1, 2),
d AS (SELECT a.k, a.customer_id, a.label, sst.label AS other, sst.n,
  greatest(0.0, sst.n * (a.Recency * a.Recency + a.Frequency * a.Frequency + a.Monetary * a.Monetary) + sst.s2
    - 2 * (a.Recency * sR + a.Frequency * sF + a.Monetary * sM)) AS t FROM lab a JOIN sst USING (k)),
ab AS (SELECT k, customer_id, max(n) FILTER (WHERE label = other) AS n,
  max(t / greatest(n - 1, 1)) FILTER (WHERE label = other) AS a, min(t / n) FILTER (WHERE label <> other) AS b FROM d GROUP BY 1, 2)
SELECT k, avg(CASE WHEN n > 1 AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0.0 END) AS silhouette FROM ab GROUP BY 1""",
          {"silhouette": RATIO})
def f10b(spark, sf):
    return CM.squared_silhouette(stand_in(scaled(spark, sf)).transform(cut), RFM3, {k: f"label_k{k}" for k in KS})


# -------------------------------------------------- monthly multivariate line

def monthly_series(spark, sf):
    """T12-T15 + F2: normalised monthly L, R', F, M per customer as arrays; the orders are read once."""
    from cohortkit.operators import series as T
    from cohortkit.plans.q_series import monthly
    m = monthly(spark, sf).transform(cut)
    n = T.minmax_scale(T.fill_series(T.month_spine(m), m), ["L", "R_prime", "F", "M"]).fillna(0.0, ["R_prime"])
    return T.pack_series(n, "month", ["L", "R_prime", "F", "M"]).transform(cut)


@register("t18_dtw_distances")
def t18(spark, sf):
    series = monthly_series(spark, sf).withColumnRenamed("customer_id", "id")
    return LM.nearest_by_dtw(series, LM.choose(series, 16))


def spectral_labels(vec, k, rest=None):
    """(id, cluster) by K-Means on the rows of the spectral embedding."""
    feats = [f"u{i}" for i in range(k)]
    flat = LM.spectral_embedding(vec, k, rest=rest).select(F.col("id").alias("customer_id"), *[F.col("u")[i].alias(f) for i, f in enumerate(feats)]).transform(cut)
    _c, _s, centres = fit_best(flat, k, n_init=10, feats=feats)
    return assign(flat, feats, centres, "cluster").select(F.col("customer_id").alias("id"), "cluster")


@register("f22_spectral_clusters")
def f22(spark, sf):
    z = rounded(spark, sf)
    members = PK.fuzzy_membership(z, RFM3, PK.density_peaks(z, RFM3, 4))
    vec = members.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("center_rank", "membership"))).alias("m"))  # four of them
    return spectral_labels(vec.select("id", F.transform("m", lambda x: x["membership"]).alias("f")), 4)


@register("t23_mts_segments")
def t23(spark, sf):
    """T12-T15 -> F2 -> T18 (all pairs of customers) -> F20 -> F21 -> F22 -> S10 -> T21."""
    from cohortkit.operators import series as T
    from cohortkit.operators.scores import rename_segments
    packed = monthly_series(spark, sf)
    series = packed.withColumnRenamed("customer_id", "id")
    peaks = WP.warping_peaks(series, 4)
    found = {str(r.id): r.series for r in series.where(F.col("id").cast("string").isin(peaks)).collect()}  # four of them
    centres = pd.DataFrame({"id": peaks, "series": [found[p] for p in peaks]})
    labels = spectral_labels(LM.memberships(LM.dtw_distances(series, centres), list(range(len(peaks)))), 4, LM.REST)
    report = T.churn_risk(T.unpack_series(packed, "month", {"M": 3}), labels.withColumnRenamed("id", "customer_id"))
    return rename_segments(report, {}, "Nombre_Segmento")


@register("j7_eps_neighbours", f"""{SCALED_SQL} SELECT a.customer_id, count(*) AS n_eps FROM sc a JOIN sc b
  ON pow(a.Recency - b.Recency, 2) + pow(a.Frequency - b.Frequency, 2) + pow(a.Monetary - b.Monetary, 2) <= 0.25
  GROUP BY a.customer_id""")
def j7(spark, sf):
    from cohortkit.operators.dbscan import eps_neighbour_counts
    return eps_neighbour_counts(scaled(spark, sf), RFM3, 0.5)


@register("h3b_lrfms_summary_given_labels", LONG_SQL + """, m AS (SELECT customer_id, avg(L) AS avg_l, avg(R) AS avg_r,
  avg(F) AS avg_f, avg(M) AS avg_m, avg(S) AS avg_s FROM lg GROUP BY 1),
s AS (SELECT *, 'Cluster ' || CAST(CAST(customer_id AS BIGINT) % 3 AS VARCHAR) AS segment FROM m),
t AS (SELECT count(*) AS n, sum(avg_m) AS rev FROM s)
SELECT segment AS label, count(*) AS count, count(*) * 100.0 / any_value(n) AS pct_customers, avg(avg_l) AS avg_l,
  avg(avg_r) AS avg_r, avg(avg_f) AS avg_f, avg(avg_m) AS avg_m, avg(avg_s) AS avg_s, avg(avg_m) AS avg_monetary,
  sum(avg_m) AS total_revenue, CASE WHEN any_value(rev) > 0 THEN sum(avg_m) * 100.0 / any_value(rev) ELSE 0.0 END AS pct_revenue,
  avg(avg_r) AS avg_recency, avg(avg_f) AS avg_frequency FROM s, t GROUP BY segment""",
          {c: RATIO for c in ["pct_customers", "avg_l", "avg_r", "avg_f", "avg_m", "avg_s", "avg_monetary",
                              "total_revenue", "pct_revenue", "avg_recency", "avg_frequency"]})
def h3b(spark, sf):
    from cohortkit.operators import series as T
    from cohortkit.plans.q_series import binned
    lg = T.lrfms_long(binned(spark, sf), 3, compute_s=True)
    m = lg.groupBy("customer_id").agg(*[F.avg(c).alias(f"avg_{c.lower()}") for c in ["L", "R", "F", "M", "S"]])
    s = m.withColumn("segment", F.concat(F.lit("Cluster "), (F.col("customer_id").cast("bigint") % 3).cast("string")))
    return H.lrfms_summary(s)
