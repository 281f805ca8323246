"""Adapters from the driver's test tables to the standard transaction schema.

The orders table carries no dirt, so the cleaning fixture derives it with
fixed rules on ``o_orderkey`` (nulls, returns, zero totals, duplicates, bad
text).  The same rules are written in SQL for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators.mapping import apply_mapping

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

ORDERS_MAPPING = {"customer_id": "o_custkey", "order_id": "o_orderkey",
                  "order_date": "o_orderdate", "order_total": "o_totalprice"}
ORDERS_KEY = ["o_orderkey"]  # primary key of the raw table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def std_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> customer_id, order_id, order_date, order_total."""
    return apply_mapping(table(spark, sf_dir, "orders"), ORDERS_MAPPING)


def raw_dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text-typed orders with the defects of the cleaning fixture."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    qty = (F.lit(1) + k % 7).cast("double")
    total = (F.when(k % 89 == 0, F.lit(None).cast("string"))
             .when(k % 53 == 0, F.lit("n/a"))
             .when(k % 101 == 0, F.lit("0.0"))
             .when(k % 13 == 0, (-F.col("o_totalprice")).cast("string"))
             .otherwise(F.col("o_totalprice").cast("string")))
    raw = o.select(
        F.when(k % 97 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("cust"),
        k.alias("ord"),
        F.when(k % 53 == 0, F.lit("n/a")).otherwise(F.col("o_orderdate").cast("string")).alias("date_txt"),
        total.alias("total_txt"),
        qty.alias("qty"),
        (F.col("o_totalprice") / qty).alias("price"),
        F.when(k % 4 == 0, F.lit(None)).otherwise((F.lit(1) + k % 10).cast("double")).alias("sat"),
    )
    return raw.unionAll(raw.where(F.col("ord") % 10 == 0))


DIRTY_MAPPING = {"customer_id": "cust", "order_id": "ord", "order_date": "date_txt",
                 "order_total": "total_txt", "quantity": "qty", "unit_price": "price",
                 "satisfaction": "sat"}


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_mapping(raw_dirty_orders(spark, sf_dir), DIRTY_MAPPING)


def std_lines_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-level transactions: lineitem joined to its order; flag R = return.

    total = extendedprice * (1 - discount), negated for returned lines.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount",
                                                 "l_returnflag", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    amount = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount).alias("order_total"),
        F.col("l_quantity").alias("quantity"),
    )


def std_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as transactions (one order per event)."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return apply_mapping(e, {"customer_id": "user_id", "order_id": "event_id",
                             "order_date": "ts", "order_total": "value"})
