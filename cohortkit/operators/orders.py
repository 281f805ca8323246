"""A and J operators: order aggregation, RFM / LRFM bases, joins.

Per-customer figures are computed in two aggregation levels, first by
(customer, order) and then by customer, so that distinct-order counts never
put all orders of a hot customer into one task: the second level is
combined map-side and ships one partial row per task and customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.core import US_PER_DAY, add_scalars, micros_between, whole_days
from cohortkit.operators.ordering import top_n_per_group
from cohortkit.session import cut

ORDER_KEYS = ["customer_id", "order_id", "order_date"]


def _aggregate(df: DataFrame, keep) -> DataFrame:
    keys = [k for k in ORDER_KEYS if k in df.columns]
    notnull = F.lit(True)
    for k in keys:  # pandas groupby drops null keys; Spark keeps them
        notnull = notnull & F.col(k).isNotNull()
    aggs = []
    if "order_total" in df.columns:
        aggs.append(F.coalesce(F.sum("order_total"), F.lit(0.0)).alias("order_total"))
    if "satisfaction" in df.columns:
        aggs.append(F.avg("satisfaction").alias("satisfaction"))
    out = df.where(notnull).groupBy(*keys).agg(*aggs)
    return out.where(keep(F.col("order_total"))) if "order_total" in df.columns else out


def aggregate_orders(df: DataFrame) -> DataFrame:
    """A1: one row per (customer, order, timestamp), total summed, mean
    satisfaction; only orders with total > 0."""
    return _aggregate(df, lambda t: t > 0)


def aggregate_orders_with_returns(df: DataFrame) -> DataFrame:
    """A2: same, keeping negative totals (returns); only exact zeros dropped."""
    return _aggregate(df, lambda t: t != 0)


def per_customer_orders(orders: DataFrame) -> DataFrame:
    """Level-1 aggregate: one row per (customer, order_id)."""
    return orders.groupBy("customer_id", "order_id").agg(
        F.sum("order_total").alias("_m"), F.min("order_date").alias("_first"),
        F.max("order_date").alias("_last"))


def rfm(orders: DataFrame, ref_date=None, ref_from: DataFrame | None = None, once: bool = False) -> DataFrame:
    """A3: Recency (whole days from last order to the reference date),
    Frequency (distinct orders), Monetary (sum).

    Reference date = max(order_date) + 1 day over ``ref_from`` (default the
    orders themselves; the scripts use the lines before the order filter),
    or the literal ``ref_date``.  ``once`` writes the per-customer totals, so
    that the orders are worked out a single time, however often the result is read.
    """
    per_cust = per_customer_orders(orders).groupBy("customer_id").agg(
        F.max("_last").alias("_last"), F.count(F.lit(1)).alias("Frequency"),
        F.sum("_m").alias("Monetary"))
    if once:
        per_cust = per_cust.transform(cut)
    if ref_date is not None:
        ref = per_cust.sparkSession.range(1).select(
            F.lit(ref_date).cast("timestamp_ntz").alias("_ref"))
    elif ref_from is not None:
        ref = ref_from.agg((F.max("order_date") + F.expr("INTERVAL 1 DAY")).alias("_ref"))
    else:
        # the global max is the max of per-customer maxima: no second scan
        ref = per_cust.agg((F.max("_last") + F.expr("INTERVAL 1 DAY")).alias("_ref"))
    return add_scalars(per_cust, ref).select(
        "customer_id", whole_days("_last", "_ref").alias("Recency"),
        F.col("Frequency").cast("bigint").alias("Frequency"), "Monetary")


def length_static(orders: DataFrame) -> DataFrame:
    """A4: first, last, distinct orders, L in fractional days."""
    return per_customer_orders(orders).groupBy("customer_id").agg(
        F.min("_first").alias("first_purchase"), F.max("_last").alias("last_purchase"),
        F.count(F.lit(1)).alias("n_orders")).withColumn(
        "L", micros_between("first_purchase", "last_purchase") / F.lit(float(US_PER_DAY)))


def lrfm_static(orders: DataFrame, p: int = 3, ref_date=None, salt_buckets: int = 32) -> DataFrame:
    """A5: L whole days first->last purchase, R' mean whole days from each of
    the last ``p`` orders to the reference date, F distinct orders, M sum.

    Reference date default = max(order_date) + 1 day.  Last-p rows are
    chosen by (order_date desc, order_id desc) with the salted two-pass top-n.
    """
    if ref_date is not None:
        ref = orders.sparkSession.range(1).select(F.lit(ref_date).cast("timestamp_ntz").alias("_ref"))
    else:
        ref = orders.agg((F.max("order_date") + F.expr("INTERVAL 1 DAY")).alias("_ref"))
    base = per_customer_orders(orders).groupBy("customer_id").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_lastd"),
        F.count(F.lit(1)).alias("F"), F.sum("_m").alias("M"))
    lastp = top_n_per_group(orders.select("customer_id", "order_id", "order_date"),
                            ["customer_id"], [F.desc("order_date"), F.desc("order_id")], p,
                            salt_buckets=salt_buckets)
    rp = add_scalars(lastp, ref).groupBy("customer_id").agg(
        F.avg(whole_days("order_date", "_ref")).alias("R"))
    return base.join(rp, "customer_id").select(
        "customer_id", whole_days("_first", "_lastd").cast("double").alias("L"),
        F.col("R").cast("double").alias("R"), F.col("F").cast("double").alias("F"),
        F.col("M").cast("double").alias("M"))


def last_purchase(rfm_df: DataFrame, orders: DataFrame) -> DataFrame:
    """Last purchase per customer, and the mean last-purchase date
    (max date - mean Recency in days) as a one-row table."""
    last = orders.groupBy("customer_id").agg(F.max("order_date").alias("last_purchase"))
    mean = add_scalars(rfm_df.agg(F.avg("Recency").alias("_mr")),
                       orders.agg(F.max("order_date").alias("_mx")))
    mean = mean.select(F.timestamp_add("MICROSECOND", (F.col("_mr") * US_PER_DAY).cast("bigint") * -1,
                                       F.col("_mx")).alias("mean_last_purchase"))
    return last, mean


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram (last bin closed); timestamps as epoch micros."""
    x = F.col(col)
    if dict(df.dtypes)[col].startswith("timestamp"):
        x = micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x)
    vals = df.select(x.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    rng = vals.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(w == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / w), F.lit(bins - 1)))
    counted = add_scalars(vals, rng).groupBy(b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    return add_scalars(counted, rng).select(
        "bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("hi"),
        "count")


def satisfaction_weighted(base: DataFrame, detail: DataFrame, quality: str = "quality",
                          delivery: str = "delivery", service: str = "service",
                          weights=(1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """S = a*mean(quality) + b*mean(delivery) + c*mean(service) per customer,
    left-joined onto ``base``."""
    a, b, c = weights
    s = detail.groupBy("customer_id").agg(
        (F.lit(a) * F.avg(quality) + F.lit(b) * F.avg(delivery) + F.lit(c) * F.avg(service)).alias("S"))
    return base.join(s, "customer_id", "left")


def orders_with_items(orders: DataFrame, items: DataFrame, product: str = "product_id",
                      price: str = "price", freight: str = "freight_value") -> DataFrame:
    """Per order the product list (sorted), item sum and item+freight sum,
    inner-joined to the orders."""
    per = items.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.col(product).cast("string"))).alias("products"),
        F.sum(price).alias("items_total"),
        F.sum(F.col(price) + F.col(freight)).alias("grand_total"))
    return orders.join(per, "order_id")


def label_join_left(labels: DataFrame, metrics: DataFrame, key: str = "customer_id") -> DataFrame:
    """J2."""
    return labels.join(metrics, key, "left")


def inner_join(left: DataFrame, right: DataFrame, key: str = "customer_id") -> DataFrame:
    """J3 (static LRFM with classic RFM)."""
    return left.join(right, key)


def semi_filter(df: DataFrame, keep: DataFrame, key: str = "customer_id") -> DataFrame:
    """Rows whose key appears in ``keep`` (isin as a semi join)."""
    return df.join(keep.select(key), key, "left_semi")
