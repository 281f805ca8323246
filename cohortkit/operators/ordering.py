"""Global order, prefix sums and exact quantiles without a single-partition window.

A window with ``orderBy`` and no ``partitionBy`` moves the whole table into
one task.  Instead the table is range-partitioned on a *total* order (ties
broken by a unique key), each range partition is numbered locally, the
per-partition counts and sums (one row per partition) are prefixed, and the
offsets are broadcast back.  Memory per task stays one range partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.operators.selection import quantiles
from cohortkit.session import cut, shuffle_partitions

_LOCAL_MASK = (1 << 33) - 1

# Group tables of at most this many rows (counted first) may be broadcast.
BROADCAST_GROUPS = 50_000


# Rows of a range partition; a table of more gets more ranges than the session's setting asks for.
ROWS_PER_RANGE = 2_000_000


def _n_parts(df: DataFrame, n_parts: int | None) -> int:
    """Ranges for a table: counted, as adaptive execution keeps an explicit number as it is."""
    return n_parts or max(shuffle_partitions(df.sparkSession), -(-df.count() // ROWS_PER_RANGE))


def global_positions(df: DataFrame, order: list[Column], pos_col: str = "pos",
                     n_parts: int | None = None) -> DataFrame:
    """Add a 1-based position in the total order ``order`` (must be unique).

    Range exchange + sort within partitions; the local index comes from
    ``monotonically_increasing_id`` (partition id << 33 | row index), so no
    second exchange is needed.  The numbered table is checkpointed so that
    both uses see the same rows even if executors are lost.  ``df`` is read
    three times (count, range bounds, exchange): cut a costly plan first.
    """
    n = _n_parts(df, n_parts)
    numbered = (df.repartitionByRange(n, *order)
                .sortWithinPartitions(*order)
                .withColumn("_mid", F.monotonically_increasing_id())
                .withColumn("_pid", F.shiftright(F.col("_mid"), 33))
                .withColumn("_local", F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK)))
                .drop("_mid")
                .transform(cut))
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per range partition: bounded by n, safe to order in one task
    offsets = counts.select(
        "_pid",
        (F.sum("_cnt").over(Window.orderBy("_pid")) - F.col("_cnt")).alias("_off"))
    return (numbered.join(F.broadcast(offsets), "_pid")
            .withColumn(pos_col, F.col("_off") + F.col("_local") + F.lit(1))
            .drop("_pid", "_local", "_off"))


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column],
                pos_col: str | None = "pos", n_parts: int | None = None) -> DataFrame:
    """Add inclusive running sums (and optionally a 1-based position) over ``order``.

    ``order`` must be a total order.  Local running sums use a window
    partitioned by the range partition id, so each window task holds one
    range partition; the per-partition totals are prefixed and broadcast.
    ``df`` is read three times (count, range bounds, exchange): cut a costly
    plan first.
    """
    n = _n_parts(df, n_parts)
    ranged = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cols = {name: F.sum(expr).over(w) for name, expr in sums.items()}
    cols["_local"] = F.count(F.lit(1)).over(w)
    local = ranged.withColumns(cols).transform(cut)
    tot = local.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("_cnt"),
        *[F.sum(expr).alias(f"_tot_{name}") for name, expr in sums.items()])
    wo = Window.orderBy("_pid")  # bounded: one row per range partition
    off = tot.select(
        "_pid",
        (F.sum("_cnt").over(wo) - F.col("_cnt")).alias("_off"),
        *[(F.sum(f"_tot_{name}").over(wo) - F.col(f"_tot_{name}")).alias(f"_off_{name}")
          for name in sums])
    out = local.join(F.broadcast(off), "_pid")
    news = {name: F.coalesce(F.col(f"_off_{name}"), F.lit(0)) + F.col(name) for name in sums}
    if pos_col:
        news[pos_col] = F.col("_off") + F.col("_local")
    out = out.withColumns(news)
    return out.drop("_pid", "_local", "_off", *[f"_off_{n}" for n in sums])


def grouped_exact_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float],
                            prefix: str = "q") -> DataFrame:
    """Exact linear-interpolation quantiles ``{prefix}0..`` of ``value`` per group.

    Same definition as numpy/pandas ``quantile`` and DuckDB ``quantile_cont``.
    Values are counted per (group, distinct value) first (map-side combined,
    so a hot value costs one row), cumulated over the global order
    (group, value) across range partitions, and each group's offset is the
    minimum of its cumulative starts (an aggregate, not a window).  Each
    quantile then picks its two neighbouring order statistics.  No task
    holds all values of a group.  The pick table (groups x probs rows) is
    broadcast up to BROADCAST_GROUPS groups (counted), beyond that joined on
    the group.  Nulls are ignored.
    """
    spark = df.sparkSession
    vals = (df.where(F.col(value).isNotNull())
            .groupBy(*group, F.col(value).cast("double").alias("_v"))
            .agg(F.count(F.lit(1)).alias("_c")).transform(cut))
    order = [F.col(g).asc() for g in group] + [F.col("_v").asc()]
    cum = prefix_sums(vals, order, {"_cum": F.col("_c")}, pos_col=None)  # checkpointed inside, read twice
    stats = cum.groupBy(*group).agg(F.min(F.col("_cum") - F.col("_c")).alias("_goff"),
                                    F.sum("_c").alias("_n")).transform(cut)
    probs_df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(probs)],
                                     "_i int, _p double")
    targets = (stats.crossJoin(F.broadcast(probs_df))
               .withColumn("_h", (F.col("_n") - 1) * F.col("_p"))
               .withColumn("_lo", F.floor("_h"))
               .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
               .withColumn("_frac", F.col("_h") - F.col("_lo"))
               .withColumn("_glo", F.col("_goff") + F.col("_lo"))
               .withColumn("_ghi", F.col("_goff") + F.col("_hi")))
    keyed = [F.col(g).alias(f"_k{i}") for i, g in enumerate(group)]
    # both neighbouring order statistics of every quantile in one broadcast join;
    # the one at global 0-based position p is in the row with cum - c <= p < cum
    wanted = targets.select(*keyed, "_i", "_frac", F.explode(F.array(
        F.struct(F.lit(0).alias("_w"), F.col("_glo").alias("_pos")),
        F.struct(F.lit(1).alias("_w"), F.col("_ghi").alias("_pos")))).alias("_t")).select(
        "*", "_t._w", "_t._pos").drop("_t")
    cond = (F.col("_cum") - F.col("_c") <= F.col("_pos")) & (F.col("_pos") < F.col("_cum"))
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    wanted = F.broadcast(wanted) if stats.count() <= BROADCAST_GROUPS else wanted
    picked = cum.join(wanted, cond).groupBy(*[f"_k{i}" for i in range(len(group))], "_i").agg(
        F.first("_frac").alias("_frac"), F.max(F.when(F.col("_w") == 0, F.col("_v"))).alias("_vlo"),
        F.max(F.when(F.col("_w") == 1, F.col("_v"))).alias("_vhi"))
    # numpy's lerp: a + (b-a)t below t=0.5, b - (b-a)(1-t) from 0.5 on
    interp = F.when(F.col("_frac") >= 0.5,
                    F.col("_vhi") - (F.col("_vhi") - F.col("_vlo")) * (F.lit(1.0) - F.col("_frac"))
                    ).otherwise(F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac"))
    q = picked.select(*[F.col(f"_k{i}").alias(g) for i, g in enumerate(group)], "_i",
                      F.when(F.col("_vlo") == F.col("_vhi"), F.col("_vlo")).otherwise(interp).alias("_q"))
    return q.groupBy(*group).pivot("_i", list(range(len(probs)))).agg(F.first("_q")).select(
        *group, *[F.col(str(i)).alias(f"{prefix}{i}") for i in range(len(probs))])


def exact_quantiles(df: DataFrame, value: str, probs: list[float], prefix: str = "q") -> DataFrame:
    """One row of exact quantiles of ``value`` over the whole table, by narrowing (``selection``).

    An empty input gives one row of nulls.
    """
    q = quantiles(df, [value], probs)[value]
    return df.sparkSession.createDataFrame([tuple(q)], ", ".join(f"{prefix}{i} double" for i in range(len(probs))))


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n,
                    rank_col: str = "rank", salt_buckets: int | None = None,
                    salt_key: list[str] | None = None) -> DataFrame:
    """Keep the first ``n`` rows of each group under ``order`` (a total order
    within the group), numbered 1..n in ``rank_col``.

    Two passes so that a hot group never lands in one task: rows are first
    spread over ``salt_buckets`` sub-groups (by default as many as there are
    shuffle partitions, which grow with the data) by a hash of ``salt_key``
    (the tie-break columns), the top ``n`` of each sub-group survive (``n`` may
    name a per-row quota column), and the
    final window sees at most ``salt_buckets * n`` rows per group.
    """
    salt_key = salt_key or [c for c in df.columns if c not in group]
    salt_buckets = salt_buckets or shuffle_partitions(df.sparkSession)
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_key), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    cand = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= limit)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (cand.drop("_salt", "_r1").withColumn(rank_col, F.row_number().over(w2))
            .where(F.col(rank_col) <= limit))
