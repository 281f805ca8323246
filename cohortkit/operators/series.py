"""T operators: interval and monthly LRFM(S) series.

Interval numbers are computed, not looked up, wherever the edges are
regular (equal-width bins: integer microsecond arithmetic).  Calendar
edges (month-end anchored, fixed day steps) are a small table bounded by
the calendar span / step and are broadcast into a range join.  Per
(customer, interval) metrics come from one grouping; the last-P rows use
the salted two-pass top-n so a hot customer never fills one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.core import US_PER_DAY, add_scalars, idiv, micros_between, whole_days
from cohortkit.operators.ordering import top_n_per_group



def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

# Churn-risk levels and the segment names of the monthly report.
RISK_HIGH = "ALTO (Abandono Inminente)"
RISK_MEDIUM = "Medio (Perdiendo Interés)"
RISK_LOW = "Bajo"
SEGMENT_NAMES = {
    0: "Important Retention (Estrellas)",
    1: "Loyal Customers (Fieles)",
    2: "Developmental (En Crecimiento)",
    3: "General Customers (Básicos)",
}
SEGMENT_OTHER = "Otros"


def _us(ts) -> Column:
    return micros_between(_epoch(), F.col(ts) if isinstance(ts, str) else ts)


def _ts(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, _epoch())


def equal_intervals(orders: DataFrame, n: int) -> DataFrame:
    """One row ``_t0`` (first purchase, micros), ``_span`` (to last purchase
    + 1 day, micros), ``_n``.  Only purchases (total >= 0) define the range."""
    p = orders.where(F.col("order_total") >= 0)
    return p.agg(F.min(_us("order_date")).alias("_t0"),
                 (F.max(_us("order_date")) + F.lit(US_PER_DAY) - F.min(_us("order_date"))).alias("_span"),
                 F.lit(n).alias("_n"))


def interval_edge(i: Column) -> Column:
    """Edge i of the equal-width bins as a timestamp (needs T1 columns)."""
    return _ts(F.col("_t0") + idiv(i * F.col("_span"), F.col("_n")))


def assign_interval(orders: DataFrame, bounds: DataFrame) -> DataFrame:
    """Bin i iff edge_i < t <= edge_(i+1), lowest edge included; rows
    outside the edges are dropped.  Integer arithmetic: i = ceil(n*dt/span)-1."""
    j = add_scalars(orders, bounds)
    dt = _us("order_date") - F.col("_t0")
    num = dt * F.col("_n")
    iv = F.greatest(F.lit(0), idiv(num + F.col("_span") - 1, F.col("_span")) - 1)
    inside = (dt >= 0) & (dt <= F.col("_span"))
    return j.where(inside).withColumn("interval", iv.cast("int")).withColumn(
        "interval_end", interval_edge(F.col("interval") + 1))


def calendar_edges(orders: DataFrame, months: int | None = 2, days: int | None = None) -> DataFrame:
    """T3 edges (interval, lo, hi): calendar span / step rows.

    Months: month-end anchored every ``months`` months up to last date + 1
    day, bins (lo, hi].  Days: every ``days`` days up to last date + ``days``,
    bins [lo, hi), so that every order has a bin."""
    after = F.expr(f"INTERVAL {days} DAY") if days else F.expr("INTERVAL 1 DAY")
    b = orders.agg(F.min("order_date").alias("_s"), (F.max("order_date") + after).alias("_e"))
    if days:
        idx = F.sequence(F.lit(0), F.floor(micros_between(F.col("_s"), F.col("_e")) / (days * US_PER_DAY)))
        edges = b.select("_s", "_e", F.posexplode(idx).alias("_j", "_k")).select(
            "_j", "_e", F.timestamp_add("DAY", F.col("_k") * days, F.col("_s")).alias("edge"))
    else:
        tod = micros_between(F.date_trunc("day", F.col("_s")), F.col("_s"))
        first = F.date_trunc("month", F.col("_s"))
        span = F.months_between(F.col("_e"), first).cast("int") + 2
        edges = b.select("_s", "_e", tod.alias("_tod"), first.alias("_m0"),
                         F.posexplode(F.sequence(F.lit(0), span)).alias("_j", "_k"))
        # candidate month-ends (with the start's time of day), first one >= start
        me = F.timestamp_add("MICROSECOND", F.col("_tod"),
                             F.last_day(F.add_months(F.col("_m0"), F.col("_k"))).cast("timestamp_ntz"))
        edges = edges.withColumn("edge", me).where(F.col("edge") >= F.col("_s"))
        w = Window.orderBy("edge")  # calendar-sized table
        edges = edges.withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") % months == 0) \
            .withColumn("_j", F.col("_r"))
    edges = edges.where(F.col("edge") <= F.col("_e")).select("edge")
    w = Window.orderBy("edge")
    e = edges.withColumn("interval", (F.row_number().over(w) - 1).cast("int"))
    return e.select("interval", F.col("edge").alias("lo"),
                    F.lead("edge").over(w).alias("hi")).where(F.col("hi").isNotNull())


def assign_calendar_interval(orders: DataFrame, edges: DataFrame) -> DataFrame:
    """T3 binning by months: lo < t <= hi, the first interval also takes t = lo; others dropped.

    Each edge row is repeated for the months it touches, so orders meet it by
    month key (a hash join), not by a range condition over all pairs."""
    months = F.sequence(F.date_trunc("month", "lo"), F.date_trunc("month", "hi"), F.expr("INTERVAL 1 MONTH"))
    e = edges.withColumn("_month", F.explode(months)).withColumnRenamed("hi", "interval_end")
    cond = ((F.col("order_date") > F.col("lo")) |
            ((F.col("interval") == 0) & (F.col("order_date") == F.col("lo")))) & \
        (F.col("order_date") <= F.col("interval_end"))
    return orders.withColumn("_month", F.date_trunc("month", "order_date")).join(e, "_month").where(cond).drop("lo", "_month")


def assign_day_interval(orders: DataFrame, days: int) -> DataFrame:
    """T3 binning by fixed days from the first order: interval = floor((t - first) / days), half open; no join."""
    j = add_scalars(orders, orders.agg(F.min("order_date").alias("_s")))
    step = F.lit(days * US_PER_DAY)
    n = F.floor(micros_between(F.col("_s"), F.col("order_date")) / step)
    out = j.withColumn("interval", n.cast("int"))
    return out.withColumn("interval_end", F.timestamp_add("DAY", (F.col("interval") + 1) * F.lit(days), F.col("_s"))).drop("_s")


# Return rate -> satisfaction score steps (0, <=2 %, <=5 %, <=10 %, <=20 %, more).
def return_rate_score(rate: Column) -> Column:
    """T6."""
    pct = rate * 100
    return (F.when(pct == 0, 9.0).when(pct <= 2, 8.5).when(pct <= 5, F.lit(8.0) - rate * 10)
            .when(pct <= 10, F.lit(6.5) - rate * 5).when(pct <= 20, 4.0).otherwise(2.0))


def lrfms_long(binned: DataFrame, p: int = 3, compute_s: bool = False, use_survey: bool = False,
               frequency: str = "orders", salt_buckets: int = 32) -> DataFrame:
    """Per (customer, interval): L, R', F, M over purchases (total >= 0),
    and optionally S (survey mean if any, else return-rate score).

    ``binned`` needs customer_id, order_id, order_date, order_total, interval,
    interval_end (and satisfaction for the survey source).
    """
    keys = ["customer_id", "interval"]
    purchase = F.col("order_total") >= 0
    fcount = (F.count_distinct(F.when(purchase, F.col("order_id"))) if frequency == "orders"
              else F.count(F.when(purchase, 1)))
    aggs = [F.first("interval_end").alias("interval_end"),
            F.min(F.when(purchase, F.col("order_date"))).alias("_first"),
            F.max(F.when(purchase, F.col("order_date"))).alias("_last"),
            fcount.cast("double").alias("F"),
            F.coalesce(F.sum(F.when(purchase, F.col("order_total"))), F.lit(0.0)).cast("double").alias("M")]
    if compute_s:
        rate = F.avg(F.when(F.col("order_total") < 0, 1.0).otherwise(0.0))
        aggs.append(return_rate_score(rate).alias("_s_rate"))
        if use_survey:
            aggs.append(F.avg("satisfaction").alias("_s_survey"))
    base = binned.groupBy(*keys).agg(*aggs)
    lastp = top_n_per_group(binned.where(purchase).select(*keys, "order_id", "order_date", "interval_end"),
                            keys, [F.desc("order_date"), F.desc("order_id")], p, salt_buckets=salt_buckets)
    rp = lastp.groupBy(*keys).agg(F.avg(whole_days("order_date", "interval_end")).alias("R"))
    out = base.join(rp, keys, "left")
    cols = [*keys, F.coalesce(whole_days("_first", "_last"), F.lit(0)).cast("double").alias("L"),
            F.coalesce(F.col("R"), F.lit(0.0)).cast("double").alias("R"), "F", "M"]
    if compute_s:
        s = F.coalesce(F.col("_s_survey"), F.col("_s_rate")) if use_survey else F.col("_s_rate")
        cols.append(s.cast("double").alias("S"))
    return out.select(*cols)


def pivot_wide(long: DataFrame, metrics: list[str], intervals: list[int]) -> DataFrame:
    """One row per customer, ``{metric}_t{i}``, missing -> 0.  ``intervals``:
    the interval numbers present in ``long`` (only those get columns)."""
    wide = long.groupBy("customer_id").pivot("interval", intervals).agg(
        *[F.first(m).alias(m) for m in metrics])
    ren = []
    for i in intervals:
        for m in metrics:
            src = f"{i}_{m}" if len(metrics) > 1 else str(i)
            ren.append(F.coalesce(F.col(f"`{src}`"), F.lit(0.0)).alias(f"{m}_t{i}"))
    return wide.select("customer_id", *ren)


def present_intervals(long: DataFrame) -> list[int]:
    """Interval numbers with any row (at most n_intervals values)."""
    return sorted(r[0] for r in long.select("interval").distinct().collect())


def dense_series(binned_long: DataFrame, edges: DataFrame, zero_r: bool = False) -> DataFrame:
    """Every customer x every interval; empty -> L, F, M = 0, R' null (or 0).
    Output size is customers x intervals by definition; the interval table
    is calendar-sized and broadcast."""
    cust = binned_long.select("customer_id").distinct()
    grid = cust.crossJoin(F.broadcast(edges.select("interval")))
    j = grid.join(binned_long, ["customer_id", "interval"], "left")
    r = F.coalesce(F.col("R"), F.lit(0.0)) if zero_r else F.col("R")
    return j.select("customer_id", "interval", F.coalesce("L", F.lit(0.0)).alias("L"), r.alias("R"),
                    F.coalesce("F", F.lit(0.0)).alias("F"), F.coalesce("M", F.lit(0.0)).alias("M"))


def month_end(month: Column) -> Column:
    """Last microsecond of the month starting at ``month``."""
    return F.timestamp_add("MICROSECOND", F.lit(-1), F.add_months(month, 1).cast("timestamp_ntz"))


def monthly_lrfm(orders: DataFrame) -> DataFrame:
    """Per (customer, month): L (first->last in month), R' (last purchase
    to month end), F distinct orders, M sum; plus the last date."""
    m = F.date_trunc("month", F.col("order_date")).cast("timestamp_ntz")
    g = orders.groupBy("customer_id", m.alias("month")).agg(
        F.min("order_date").alias("_first"), F.max("order_date").alias("last_date"),
        F.count_distinct("order_id").cast("double").alias("F"), F.sum("order_total").cast("double").alias("M"))
    return g.select("customer_id", "month", whole_days("_first", "last_date").cast("double").alias("L"),
                    whole_days("last_date", month_end(F.col("month"))).cast("double").alias("R_prime"),
                    "F", "M", "last_date")


def month_spine(monthly: DataFrame) -> DataFrame:
    """Each customer's months from the first to the global last month."""
    last = monthly.agg(F.max("month").alias("_mx"))
    first = monthly.groupBy("customer_id").agg(F.min("month").alias("_m0"))
    return add_scalars(first, last).select(
        "customer_id", F.explode(F.sequence(F.col("_m0"), F.col("_mx"), F.expr("INTERVAL 1 MONTH"))).alias("month"))


def fill_series(spine: DataFrame, monthly: DataFrame) -> DataFrame:
    """T14 (with J4): spine left join metrics; L, F, M -> 0; last purchase
    carried forward within the customer; R' from it (null before any).

    Spine rows meet one array of all months with purchases of their customer
    (T12: one row each) and take the latest up to theirs, so the spine, dealt
    by customer as T13 leaves it, is neither exchanged nor put into a window."""
    w = Window.partitionBy("customer_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    known = monthly.withColumn("_carry", F.last("last_date", ignorenulls=True).over(w))
    known = known.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("month", "L", "F", "M", "_carry"))).alias("_m"))
    past = F.filter("_m", lambda x: x["month"] <= F.col("month"))
    out = spine.join(known, "customer_id", "left").select("customer_id", "month", F.try_element_at(past, F.lit(-1)).alias("_p"))
    own = lambda c: F.coalesce(F.when(F.col("_p.month") == F.col("month"), F.col(f"_p.{c}")), F.lit(0.0)).alias(c)
    return out.select("customer_id", "month", own("L"), whole_days("_p._carry", month_end(F.col("month"))).cast("double").alias("R_prime"),
                      own("F"), own("M"))


def minmax_scale(df: DataFrame, cols: list[str], zero_range: float | None = None, fill_null: float | None = None,
                 clip: bool = False) -> DataFrame:
    """(x - min) / (max - min) per column over all rows."""
    stats = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    j = add_scalars(df, stats)
    new = {}
    for c in cols:
        rng = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        v = F.try_divide(F.col(c) - F.col(f"_lo_{c}"), rng)  # a constant column: null unless zero_range says
        if zero_range is not None:
            v = F.when(rng == 0, F.lit(zero_range)).otherwise(v)
        if fill_null is not None:
            v = F.coalesce(v, F.lit(fill_null))
        if clip:
            v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        new[c] = v
    return j.withColumns(new).drop(*[f"_lo_{c}" for c in cols], *[f"_hi_{c}" for c in cols])


def pack_series(series: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """One ordered array of metric rows per customer (calendar-bounded)."""
    st = F.struct(F.col(order).alias("t"), *[F.col(m).cast("double").alias(m) for m in metrics])
    packed = series.groupBy("customer_id").agg(F.sort_array(F.collect_list(st)).alias("_s"))
    return packed.select("customer_id", F.transform("_s", lambda x: F.array(*[x[m] for m in metrics])).alias("series"))


def unpack_series(packed: DataFrame, order: str, metrics: dict[str, int]) -> DataFrame:
    """T15 backwards: one row per customer and place in its series (``order``, from 0), ``metrics`` by their index in a point.

    Rows stay dealt by customer, so a step per customer that follows exchanges none of them.
    """
    rows = packed.select("customer_id", F.transform("series", lambda p: F.struct(*[p[i].alias(m) for m, i in metrics.items()])).alias("_s"))
    return rows.repartition("customer_id").select("customer_id", F.posexplode("_s").alias(order, "_p")).select("customer_id", order, "_p.*")


def active_customers(series: DataFrame, min_frequency: float = 5) -> DataFrame:
    """Customers whose total F over the series is at least ``min_frequency``."""
    return series.groupBy("customer_id").agg(F.sum("F").alias("total_F")).where(
        F.col("total_F") >= min_frequency)


def cluster_trends(series: DataFrame, labels: DataFrame, value: str = "M") -> DataFrame:
    """Mean ``value`` per cluster and months since the customer's first
    month, with a 3-point trailing mean (min 1 point)."""
    w = Window.partitionBy("customer_id").orderBy("month")
    idx = series.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))
    per = idx.join(labels, "customer_id").groupBy("cluster", "idx").agg(F.avg(value).alias("avg_value"))
    wt = Window.partitionBy("cluster").orderBy("idx").rowsBetween(-2, 0)  # months-sized per cluster
    return per.withColumn("trend", F.avg("avg_value").over(wt))


def churn_risk(series: DataFrame, labels: DataFrame, value: str = "M") -> DataFrame:
    """Per customer the slope of ``value`` over its month index (0 for
    one month), risk level, mean value; named segment of its cluster."""
    w = Window.partitionBy("customer_id").orderBy("month")
    idx = series.withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    g = idx.groupBy("customer_id").agg(F.coalesce(F.regr_slope(value, "_i"), F.lit(0.0)).alias("_slope"),
                                       F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    slope = F.when(F.col("_n") > 1, F.col("_slope")).otherwise(F.lit(0.0))
    names = F.create_map(*[F.lit(x) for kv in SEGMENT_NAMES.items() for x in kv])
    out = g.join(labels, "customer_id").select(
        F.col("customer_id").alias("User_ID"), F.col("cluster").alias("Segmento_ID"),
        F.coalesce(names[F.col("cluster")], F.lit(SEGMENT_OTHER)).alias("Nombre_Segmento"),
        F.round(slope, 4).alias("Pendiente_Tendencia"),
        F.when(slope < -0.05, RISK_HIGH).when(slope < -0.01, RISK_MEDIUM).otherwise(RISK_LOW).alias("Nivel_de_Riesgo"),
        F.round(F.col("_mean"), 4).alias("Valor_Monetario_Promedio"))
    return out.orderBy("Nivel_de_Riesgo", F.desc("Valor_Monetario_Promedio"))
