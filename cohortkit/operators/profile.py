"""P operators: data-quality profiles, each one aggregate pass over the table."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.functions.core import is_negative
from cohortkit.operators.ordering import exact_quantiles
from cohortkit.operators.selection import quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def is_missing(df: DataFrame, c: str):
    """pandas isnull: null, or NaN in a floating column."""
    dt = df.schema[c].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()


def quality_report(df: DataFrame) -> DataFrame:
    """Total rows, rows with any null, rows with any negative, duplicate rows.

    Duplicates = rows minus distinct rows (a grouping over all columns,
    combined map-side, so repeated rows cost one row each in the shuffle).
    """
    nums = numeric_columns(df)
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | is_missing(df, c)
    any_neg = F.lit(False)
    for c in nums:
        any_neg = any_neg | is_negative(c)
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))  # one scan; all counts follow from it

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return rows.agg(total(F.col("_n")).alias("total_rows"), total(F.when(any_null, F.col("_n"))).alias("null_rows"),
                    total(F.when(any_neg, F.col("_n"))).alias("negative_rows"), total(F.col("_n") - 1).alias("duplicate_rows"))


def _per_column(df: DataFrame, cols: list[str], cond, name: str) -> DataFrame:
    """One aggregate row of per-column counts, unpivoted to (column, count, pct)."""
    if not cols:
        schema = f"column_name string, {name} bigint, pct double"
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(F.count(F.lit(1)).alias("_total"),
                  *[F.count(F.when(cond(c), 1)).alias(f"_c_{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', _c_{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("_total", f"stack({len(cols)}, {stack}) as (column_name, {name})")
    return long.select("column_name", F.col(name).cast("bigint").alias(name),
                       F.when(F.col("_total") > 0, F.col(name) * 100.0 / F.col("_total"))
                       .otherwise(0.0).alias("pct"))


def nulls_by_column(df: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Null count and percent per column; only columns with nulls by default."""
    out = _per_column(df, df.columns, lambda c: is_missing(df, c), "nulls")
    return out if keep_zero else out.where(F.col("nulls") > 0)


def negatives_by_column(df: DataFrame, keep_zero: bool = True) -> DataFrame:
    """Negative count and percent per numeric column."""
    out = _per_column(df, numeric_columns(df), lambda c: F.col(c) < 0, "negatives")
    return out if keep_zero else out.where(F.col("negatives") > 0)


def cell_totals(df: DataFrame) -> DataFrame:
    """Total null cells and total negative cells, in one aggregate."""
    def flags(cols, cond):
        return reduce(lambda a, b: a + b, [F.when(cond(c), 1).otherwise(0) for c in cols], F.lit(0))

    def total(value, name):
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name)

    return df.agg(total(flags(df.columns, lambda c: is_missing(df, c)), "null_cells"),
                  total(flags(numeric_columns(df), is_negative), "negative_cells"))


def column_info(df: DataFrame) -> DataFrame:
    """P5: per column its type, null count and percent."""
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
        "column_name string, dtype string")
    return types.join(F.broadcast(nulls_by_column(df, keep_zero=True)), "column_name")


def validation_report(df: DataFrame, required: list[str] | None = None,
                      max_null_pct: float = 10.0, approx: bool = False, totals: bool = False) -> DataFrame:
    """Per column nulls, percent (2 dp), distinct values, and an error flag
    for a required column with more than ``max_null_pct`` percent nulls;
    ``totals`` adds the number of rows."""
    required = set(required if required is not None else df.columns)
    names = list(enumerate(df.columns))
    wide = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count(F.when(is_missing(df, c), 1)).alias(f"_c_{i}") for i, c in names],
                  *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"_d_{i}") for i, c in names if approx])
    stack = ", ".join(f"'{c}', _c_{i}, {f'_d_{i}' if approx else 'CAST(NULL AS BIGINT)'}, {str(c in required).lower()}" for i, c in names)
    long = wide.selectExpr("_total", f"stack({len(names)}, {stack}) as (column_name, nulls, distinct_values, required)")
    if not approx:
        found = distinct_counts(df).withColumnRenamed("distinct_values", "_n")  # one row per column
        long = long.join(F.broadcast(found), "column_name", "left").withColumn("distinct_values", F.coalesce("_n", F.lit(0)))
    pct = F.when(F.col("_total") > 0, F.col("nulls") * 100.0 / F.col("_total")).otherwise(0.0)
    return (long.withColumn("pct", pct)
            .select("column_name", *([F.col("_total").alias("total_rows")] if totals else []),
                    F.col("nulls").cast("bigint").alias("nulls"), F.round("pct", 2).alias("pct_nulls"),
                    F.col("distinct_values").cast("bigint").alias("distinct_values"),
                    (F.col("required") & (F.col("pct") > max_null_pct)).alias("error")))


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column_name, distinct_values) of all columns in one scan, exactly (nulls left out; columns without values: no row).

    Every batch of rows names its distinct values once per column by 128 bits,
    so a column of few values travels as few rows; the names are then counted
    by (column, name).  Counting all columns in one aggregate would copy every
    row once per column instead.
    """
    names = df.columns
    text = [F.when(F.isnan(F.col(f"`{c}`")), F.lit("NaN")).otherwise((F.col(f"`{c}`") + F.lit(0.0)).cast("string"))  # -0.0 is 0.0
            if t in ("double", "float") else F.col(f"`{c}`").cast("string") for c, t in df.dtypes]
    rows = df.select(*[t.alias(f"c{i}") for i, t in enumerate(text)])

    def run(batches):
        for batch in batches:
            for i, column in enumerate(batch.columns):
                values = [hashlib.md5(v.encode()).digest() for v in column.unique().to_pylist() if v is not None]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(values), pa.int32()), pa.array(values, pa.binary())], names=["i", "h"])

    found = rows.mapInArrow(run, "i int, h binary").groupBy("i", "h").agg(F.count(F.lit(1)).alias("n"))
    label = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1)
    return found.groupBy("i").agg(F.count(F.lit(1)).alias("distinct_values")).select(label.alias("column_name"), "distinct_values")


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max per numeric column."""
    cols = cols or numeric_columns(df)
    wide = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.count(c).alias(f"n_{i}"), F.avg(c).alias(f"a_{i}"), F.stddev_samp(c).alias(f"s_{i}"),
        F.min(F.col(c).cast("double")).alias(f"l_{i}"), F.max(F.col(c).cast("double")).alias(f"h_{i}"))])
    stats = wide.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("count"), F.col(f"a_{i}").cast("double").alias("mean"),
        F.col(f"s_{i}").alias("std"), F.col(f"l_{i}").alias("min"), F.col(f"h_{i}").alias("max"))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")
    found = quantiles(df, cols, [0.25, 0.5, 0.75])
    q = F.broadcast(df.sparkSession.createDataFrame([(c, *found[c]) for c in cols], "column_name string, p0 double, p1 double, p2 double"))
    return stats.join(q, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", F.col("p0").alias("p25"), F.col("p1").alias("p50"),
        F.col("p2").alias("p75"), "max")


def amount_stats(df: DataFrame, col: str = "order_total") -> DataFrame:
    """Mean, exact median, min, max of one amount column."""
    s = df.agg(F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))
    return s.crossJoin(exact_quantiles(df, col, [0.5], prefix="median")).select(
        "mean", F.col("median0").alias("median"), "min", "max")


def severity_band(df: DataFrame, limit_pct: float = 10.0) -> DataFrame:
    """Per column, none / low (<= limit) / high (> limit) by max(nulls, negatives)."""
    nums = set(numeric_columns(df))
    wide = df.agg(F.count(F.lit(1)).alias("_t"), *[x for i, c in enumerate(df.columns) for x in (
        F.count(F.when(is_missing(df, c), 1)).alias(f"_c_{i}"),
        (F.count(F.when(F.col(c) < 0, 1)) if c in nums else F.count(F.when(F.lit(False), 1))).alias(f"_g_{i}"))])
    stack = ", ".join(f"'{c}', _c_{i}, _g_{i}" for i, c in enumerate(df.columns))
    j = wide.selectExpr("_t", f"stack({len(df.columns)}, {stack}) as (column_name, nulls, negatives)")
    worst = F.greatest("nulls", "negatives")
    return j.select("column_name", F.col("nulls").cast("bigint").alias("nulls"), F.col("negatives").cast("bigint").alias("negatives"),
                    F.when(worst == 0, "none")
                    .when(F.try_divide(worst * 100.0, F.col("_t")) > limit_pct, "high")
                    .otherwise("low").alias("band"))


def order_totals_kpi(orders: DataFrame) -> DataFrame:
    """P10: orders, distinct customers, revenue."""
    return orders.agg(F.count_distinct("order_id").alias("n_orders"),
                      F.count_distinct("customer_id").alias("n_customers"),
                      F.sum("order_total").alias("revenue"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key value, most frequent first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), key)
