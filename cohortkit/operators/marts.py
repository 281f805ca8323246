"""H operators: per-segment summaries and dashboard tables.

Segment-level tables have one row per segment (bounded by the rule list or
k_max), so windows over them are cheap; anything per customer goes through
the salted top-n or the distributed prefix sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.core import add_scalars
from cohortkit.operators.ordering import grouped_exact_quantiles, top_n_per_group



def _all():
    return Window.partitionBy()  # over a per-segment table only (bounded)


def _round(c, digits):
    return F.bround(c, digits) if digits is not None else c


def segment_summary(df: DataFrame, seg: str = "segment", r: str | None = "Recency",
                    f: str | None = "Frequency", m: str = "Monetary",
                    digits: int | None = None) -> DataFrame:
    """H1: count, % customers, mean R/F/M, revenue, % revenue (0 if no revenue)."""
    aggs = [F.count(F.lit(1)).alias("count")]
    if r:
        aggs.append(F.avg(r).alias("avg_recency"))
    if f:
        aggs.append(F.avg(f).alias("avg_frequency"))
    aggs += [F.avg(m).alias("avg_monetary"), F.sum(m).alias("total_revenue")]
    per = df.groupBy(F.col(seg).alias("label")).agg(*aggs)
    tot = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(m).alias("_rev"))
    j = add_scalars(per, tot)
    cols = ["label", "count", _round(F.col("count") * 100.0 / F.col("_n"), digits).alias("pct_customers")]
    for c in ["avg_recency", "avg_frequency", "avg_monetary", "total_revenue"]:
        if c in per.columns:
            cols.append(_round(F.col(c), digits).alias(c))
    cols.append(F.when(F.col("_rev") > 0,
                       _round(F.col("total_revenue") * 100.0 / F.col("_rev"), digits))
                .otherwise(F.lit(0.0)).alias("pct_revenue"))
    return j.select(*cols).orderBy(F.desc("count"), "label")


def abc_summary(df: DataFrame, digits: int | None = None) -> DataFrame:
    """H2: as H1 without R/F; ordered A, B, C."""
    return segment_summary(df, "segment", None, None, "monetary", digits).orderBy("label")


def lrfms_summary(df: DataFrame, seg: str = "segment", digits: int | None = None) -> DataFrame:
    """H3: per segment the mean of every ``avg_*`` metric; "revenue" is the
    sum of per-customer mean interval M (kept as in the original)."""
    metrics = [c for c in df.columns if c.startswith("avg_")]
    aggs = [F.count(F.lit(1)).alias("count")] + [F.avg(c).alias(c) for c in metrics]
    if "avg_m" in metrics:
        aggs.append(F.sum("avg_m").alias("total_revenue"))
    per = df.groupBy(F.col(seg).alias("label")).agg(*aggs)
    tot_aggs = [F.count(F.lit(1)).alias("_n")]
    if "avg_m" in metrics:
        tot_aggs.append(F.sum("avg_m").alias("_rev"))
    j = add_scalars(per, df.agg(*tot_aggs))
    cols = ["label", "count", _round(F.col("count") * 100.0 / F.col("_n"), digits).alias("pct_customers")]
    cols += [_round(F.col(c), digits).alias(c) for c in metrics]
    if "avg_m" in metrics:
        cols += [_round(F.col("avg_m"), digits).alias("avg_monetary"),
                 _round(F.col("total_revenue"), digits).alias("total_revenue"),
                 F.when(F.col("_rev") > 0, _round(F.col("total_revenue") * 100.0 / F.col("_rev"), digits))
                 .otherwise(F.lit(0.0)).alias("pct_revenue")]
    if "avg_r" in metrics:
        cols.append(_round(F.col("avg_r"), digits).alias("avg_recency"))
    if "avg_f" in metrics:
        cols.append(_round(F.col("avg_f"), digits).alias("avg_frequency"))
    return j.select(*cols).orderBy(F.desc("count"), "label")


def score_means(df: DataFrame, seg: str = "segment") -> DataFrame:
    """H4: mean R/F/M score per segment."""
    return df.groupBy(F.col(seg).alias("label")).agg(
        F.avg("Recency_score").alias("avg_r_score"), F.avg("Frequency_score").alias("avg_f_score"),
        F.avg("Monetary_score").alias("avg_m_score"))


def scatter_sample(df: DataFrame, cols: list[str], seg: str = "segment", cap: int = 2000,
                   seed: int = 42) -> DataFrame:
    """H5: at most ``cap`` rows when the table is larger, quota per segment
    max(1, floor(cap * n_s / n)); rows chosen by a seeded hash (deterministic).
    Nulls -> 0 in numeric columns."""
    counts = df.groupBy(seg).agg(F.count(F.lit(1)).alias("_ns"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    quota = add_scalars(counts, n).select(
        seg, F.when(F.col("_n") > cap, F.greatest(F.lit(1), F.floor(F.lit(cap) * F.col("_ns") / F.col("_n"))))
        .otherwise(F.col("_ns")).alias("_quota"))
    h = df.select(*cols, F.md5(F.concat(F.lit(f"{seed}:"), F.col("customer_id").cast("string"))).alias("_h"))
    h = h.join(F.broadcast(quota), seg)  # one row per segment
    picked = top_n_per_group(h, [seg], [F.col("_h"), F.col("customer_id")], "_quota",
                             salt_key=["customer_id"])
    return picked.select(*cols).fillna(0)


def top_per_segment(df: DataFrame, cols: list[str], value: str = "Monetary", n: int = 10,
                    seg: str = "segment") -> DataFrame:
    """H6: the ``n`` largest by ``value`` in each segment (ties by customer_id)."""
    return top_n_per_group(df.select(*cols), [seg], [F.desc(value), F.asc("customer_id")], n,
                           salt_key=["customer_id"])


def pareto_curve(abc_df: DataFrame, points: int = 300) -> DataFrame:
    """H7: every floor(n/points)-th customer by revenue plus the last one;
    x = % customers, y = cumulative % revenue (2 dp).  Needs ``pos``."""
    n = abc_df.agg(F.count(F.lit(1)).alias("_n"))
    j = add_scalars(abc_df, n)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    idx = F.col("pos") - 1
    keep = (idx % step == 0) | (idx == F.col("_n") - 1)
    return j.where(keep).select(
        F.col("pos").cast("bigint").alias("pos"),
        F.round(F.col("pos") * 100.0 / F.col("_n"), 2).alias("x"),
        F.round(F.col("cumulative_pct") * 100.0, 2).alias("y"), "segment")


def abc_thresholds(abc_df: DataFrame) -> DataFrame:
    """H8: A and B cut positions in % customers (x) and % revenue (y)."""
    s = abc_df.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("segment") == "A", 1)).alias("_na"),
        F.count(F.when(F.col("segment") == "B", 1)).alias("_nb"),
        F.max(F.when(F.col("segment") == "A", F.col("cumulative_pct"))).alias("_ya"),
        F.max(F.when(F.col("segment") == "B", F.col("cumulative_pct"))).alias("_yb"))
    a_y = F.coalesce(F.round(F.col("_ya") * 100, 1), F.lit(0.0))
    return s.select(F.round(F.col("_na") * 100.0 / F.col("_n"), 1).alias("a_x"),
                    F.round((F.col("_na") + F.col("_nb")) * 100.0 / F.col("_n"), 1).alias("b_x"),
                    a_y.alias("a_y"),
                    F.coalesce(F.round(F.col("_yb") * 100, 1), a_y).alias("b_y"))


def cluster_stats(df: DataFrame, metrics: dict, seg: str = "segment") -> DataFrame:
    """H9: mean, sample std (null for one row), min, max per segment and metric.

    ``metrics``: {output name: column}.  NaN/inf -> null.
    """
    aggs = []
    for name, c in metrics.items():
        aggs += [F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_std"),
                 F.min(F.col(c).cast("double")).alias(f"{name}_min"),
                 F.max(F.col(c).cast("double")).alias(f"{name}_max")]
    out = df.groupBy(F.col(seg).alias("segment")).agg(*aggs)
    safe = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c))
            for c in out.columns if c != "segment"}
    return out.withColumns(safe).orderBy("segment")


def detect_quantiles(df: DataFrame) -> DataFrame:
    """H10."""
    return df.agg(F.max("Recency_score").cast("int").alias("n_quantiles"))


def profile_minmax(summary: DataFrame, cols: list[str]) -> DataFrame:
    """Segment means min-max scaled over segments (constant -> 0.5)."""
    out = summary
    for c in cols:
        lo, hi = F.min(c).over(_all()), F.max(c).over(_all())
        out = out.withColumn(f"{c}_norm", F.when(hi == lo, F.lit(0.5)).otherwise((F.col(c) - lo) / (hi - lo)))
    return out


def profile_pct_of_max(summary: DataFrame, cols: list[str]) -> DataFrame:
    """Segment means as % of the largest segment mean."""
    out = summary
    for c in cols:
        mx = F.max(c).over(_all())
        out = out.withColumn(f"{c}_pct", F.when(mx == 0, F.lit(0.0)).otherwise(F.col(c) * 100.0 / mx))
    return out


def revenue_share(summary: DataFrame) -> DataFrame:
    """% customers vs % revenue, ordered by revenue."""
    return summary.select("label", "pct_customers", "pct_revenue", "total_revenue").orderBy(
        F.desc("total_revenue"), "label")


def bubble(summary: DataFrame) -> DataFrame:
    """Mean R, mean M, count, mean F per segment."""
    return summary.select("label", "avg_recency", "avg_monetary", "count", "avg_frequency")


def cluster_profile(df: DataFrame, seg: str, metrics: list[str], sums: list[str] = (),
                    digits: int | None = None) -> DataFrame:
    """Per cluster the metric means, optional sums, count and % of customers."""
    aggs = [F.avg(c).alias(c) for c in metrics] + [F.sum(c).alias(f"{c}_sum") for c in sums]
    per = df.groupBy(seg).agg(*aggs, F.count(F.lit(1)).alias("count"))
    j = add_scalars(per, df.agg(F.count(F.lit(1)).alias("_n")))
    return j.select(seg, *[_round(F.col(c), digits).alias(c) for c in metrics],
                    *[F.col(f"{c}_sum") for c in sums], "count",
                    (F.col("count") * 100.0 / F.col("_n")).alias("pct")).orderBy(seg)


def run_kpis(df: DataFrame, seg: str = "segment", r: str = "Recency", m: str = "Monetary",
             extra: dict | None = None) -> DataFrame:
    """Metric / value table of a run."""
    k = df.agg(F.count(F.lit(1)).cast("double").alias("total_customers"),
               F.count_distinct(seg).cast("double").alias("clusters"),
               F.avg(r).alias("mean_recency"), F.avg(m).alias("mean_monetary"))
    for name, v in (extra or {}).items():
        k = k.withColumn(name, F.lit(float(v)))
    stack = ", ".join(f"'{c}', {c}" for c in k.columns)
    return k.selectExpr(f"stack({len(k.columns)}, {stack}) as (metric, value)")


def normalised_wcss(scores: DataFrame) -> DataFrame:
    """WCSS min-max over the evaluated k (constant -> 1)."""
    lo, hi = F.min("wcss").over(_all()), F.max("wcss").over(_all())
    return scores.select("k", "wcss", F.when(hi == lo, F.lit(1.0))
                         .otherwise((F.col("wcss") - lo) / (hi - lo)).alias("wcss_norm"))


def segment_counts_share(df: DataFrame, seg: str = "segment") -> DataFrame:
    """Customers and % per segment (bar / pie / treemap data)."""
    per = df.groupBy(F.col(seg).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    j = add_scalars(per, df.agg(F.count(F.lit(1)).alias("_n")))
    return j.select("label", "count", (F.col("count") * 100.0 / F.col("_n")).alias("pct")).orderBy(
        F.desc("count"), "label")


def boxplot_stats(df: DataFrame, value: str, seg: str = "segment") -> DataFrame:
    """Min, quartiles, median, max of ``value`` per segment (exact)."""
    q = grouped_exact_quantiles(df, [seg], value, [0.0, 0.25, 0.5, 0.75, 1.0], prefix="q")
    return q.select(seg, F.col("q0").alias("min"), F.col("q1").alias("q1"),
                    F.col("q2").alias("median"), F.col("q3").alias("q3"), F.col("q4").alias("max"))
