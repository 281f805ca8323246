"""C operators: deduplication, null/negative filters, the cleaning flow and its stats.

All steps are filters on one scan except dedup (one shuffle on the row).
The statistics of the whole flow come from flags on the mapped table and a
single aggregate, instead of one count per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.core import is_negative, not_zero
from cohortkit.operators.mapping import apply_mapping
from cohortkit.operators.profile import is_missing, numeric_columns

KEY_COLUMNS = ["customer_id", "order_id", "order_date", "order_total"]


def dedup_raw(raw: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Drop rows repeated over all raw columns.

    Where the source declares a ``key``, rows are compared by it and by 128
    bits over all columns (nulls told apart), so columns that nobody needs are read but
    not exchanged; rows that share the key with other contents all stay.
    """
    if not key:
        return raw.dropDuplicates()
    cols = [F.col(f"`{c}`") for c in raw.columns]
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    marked = raw.withColumns({"_h1": F.xxhash64(nulls, *cols), "_h2": F.xxhash64(F.lit(1), nulls, *cols)})
    return marked.dropDuplicates([*key, "_h1", "_h2"]).drop("_h1", "_h2")


def dedup_mapped(df: DataFrame) -> DataFrame:
    """C2."""
    return df.dropDuplicates()


def drop_null_keys(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in customer/order/date/total (those present)."""
    keys = [k for k in (keys or KEY_COLUMNS) if k in df.columns]
    return drop_null_in(df, keys)


def drop_any_null(df: DataFrame) -> DataFrame:
    """C4."""
    return drop_null_in(df, df.columns)


def drop_null_in(df: DataFrame, cols: list[str]) -> DataFrame:
    """C7 (NaN counts as null, as in pandas)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~is_missing(df, c)
    return df.where(cond)


def any_negative(cols: list[str]) -> Column:
    cond = F.lit(False)
    for c in cols:
        cond = cond | is_negative(c)
    return cond


def drop_negative_rows(df: DataFrame) -> DataFrame:
    """Drop rows with a negative value in any numeric column."""
    return df.where(~any_negative(numeric_columns(df)))


def drop_negative_in(df: DataFrame, cols: list[str]) -> DataFrame:
    """C6."""
    return df.where(~any_negative(cols))


def fill_nulls(df: DataFrame, values: dict) -> DataFrame:
    """Fill chosen columns, value cast to the column type; adds ``filled`` count column."""
    filled = F.lit(0)
    new = {}
    for c, v in values.items():
        filled = filled + F.when(F.col(c).isNull(), 1).otherwise(0)
        new[c] = F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
    return df.withColumn("filled", filled).withColumns(new)


def strip_zero_total(df: DataFrame, returns_mode: bool = False) -> DataFrame:
    """Keep order_total > 0, or in returns mode order_total != 0 (null kept)."""
    if returns_mode:
        return df.where(not_zero("order_total"))
    return df.where(F.col("order_total") > 0)


def keep_positive_qty_price(df: DataFrame, qty: str = "quantity", price: str = "unit_price") -> DataFrame:
    """C10."""
    return df.where((F.col(qty) > 0) & (F.col(price) > 0))


def period_filter(df: DataFrame, start, end, col: str = "order_date") -> DataFrame:
    """Half-open [start, end) on the order date (pushed to the scan)."""
    return df.where((F.col(col) >= F.lit(start).cast("timestamp_ntz")) &
                    (F.col(col) < F.lit(end).cast("timestamp_ntz")))


def clean(df: DataFrame, remove_nulls: bool = True, remove_negatives: bool = True,
          remove_duplicates: bool = True) -> DataFrame:
    """Dedup -> null keys -> negatives -> zero totals, each step optional."""
    if remove_duplicates:
        df = df.dropDuplicates()
    if remove_nulls:
        df = drop_null_keys(df)
    if remove_negatives:
        df = drop_negative_rows(df)
    if "order_total" in df.columns:
        df = strip_zero_total(df, returns_mode=not remove_negatives)
    return df


def clean_raw(raw: DataFrame, mapping: dict, remove_nulls: bool = True, remove_negatives: bool = True,
              remove_duplicates: bool = True, key: list[str] | None = None, **mapping_options) -> DataFrame:
    """C1 + M5 + C13: duplicates are whole *raw* rows (a declared ``key`` only makes them cheaper to find).

    Lines of one order that differ only in unmapped columns (two products of
    one price) are different sales; mapping first would merge them.
    """
    rows = dedup_raw(raw, key) if remove_duplicates else raw
    return clean(apply_mapping(rows, mapping, **mapping_options), remove_nulls, remove_negatives, remove_duplicates=False)


def clean_stats_raw(raw: DataFrame, mapping: dict, remove_nulls: bool = True, remove_negatives: bool = True,
                    remove_duplicates: bool = True, **mapping_options) -> DataFrame:
    """C11 with duplicates counted on the raw rows."""
    if not remove_duplicates:
        return clean_stats(apply_mapping(raw, mapping, **mapping_options), remove_nulls, remove_negatives, False)
    names = raw.columns
    counted = raw.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    mapped = apply_mapping(counted, {**mapping, "_copies": "_copies"}, **mapping_options)
    return clean_stats(mapped.withColumn("_copies", F.col("_copies").cast("bigint")), remove_nulls, remove_negatives, True,
                       copies="_copies")


def clean_stats(df: DataFrame, remove_nulls: bool = True, remove_negatives: bool = True,
                remove_duplicates: bool = True, copies: str | None = None) -> DataFrame:
    """C11: rows before/after, rows removed per step, distinct customers and orders.

    ``copies`` names a column that already counts the copies of each row.

    Each row gets the index of the step that removes it (dedup marks every
    copy after the first); one aggregate then counts all steps together.
    """
    nums = [c for c in numeric_columns(df) if c != copies]
    keys = [k for k in KEY_COLUMNS if k in df.columns]
    if copies:
        counted = df
    elif remove_duplicates:
        counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    else:
        counted = df.withColumn("_copies", F.lit(1))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | is_missing(df, k)
    step = (F.when(F.lit(remove_nulls) & null_key, 2)
            .when(F.lit(remove_negatives) & any_negative(nums), 3))
    if "order_total" in df.columns:
        keep_total = (F.col("order_total") > 0) if remove_negatives else not_zero("order_total")
        step = step.when(~F.coalesce(keep_total, F.lit(False)), 4)
    step = step.otherwise(0)
    flagged = counted.withColumn("_step", step)
    kept = F.col("_step") == 0
    return flagged.agg(
        F.sum("_copies").cast("bigint").alias("rows_before"),
        F.sum(F.when(kept, 1).otherwise(0)).cast("bigint").alias("rows_after"),
        F.sum(F.col("_copies") - 1).cast("bigint").alias("removed_duplicates"),
        F.sum(F.when(F.col("_step") == 2, 1).otherwise(0)).cast("bigint").alias("removed_nulls"),
        F.sum(F.when(F.col("_step") == 3, 1).otherwise(0)).cast("bigint").alias("removed_negatives"),
        F.sum(F.when(F.col("_step") == 4, 1).otherwise(0)).cast("bigint").alias("removed_zero_total"),
        F.count_distinct(F.when(kept, F.col("customer_id"))).alias("unique_customers"),
        F.count_distinct(F.when(kept, F.col("order_id"))).alias("unique_orders"),
    )
