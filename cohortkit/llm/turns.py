"""Conversation turns in one global order, cut into blocks.

A conversation may hold a third of all rows, so no step gathers one whole.
Turns are range-partitioned by (conversation, order columns, row number): a
long conversation spans as many partitions as it needs, repeated rows too.
Blocks are runs of at most the square root of the longest conversation's rows
(``LEAST_BLOCK`` at least) inside one partition, so both a block and the list
of a conversation's blocks stay near that root.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import cut

LEAST_BLOCK = 256
_ROW = (1 << 33) - 1  # monotonically_increasing_id: partition << 33 | row


def number(turns: DataFrame, order: list[str], drop: tuple = ()) -> DataFrame:
    """``turns`` (with a column ``conv``) and ``at``, unique and rising by conv, ``order`` (nulls first); written once."""
    keys = [F.col(c).asc_nulls_first() for c in ("conv", *order, "_rid")]
    rows = turns.withColumn("_rid", F.monotonically_increasing_id())
    return (rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .withColumn("at", F.monotonically_increasing_id()).drop("_rid", *drop).transform(cut))


def block_size(numbered: DataFrame, least: int = LEAST_BLOCK) -> int:
    longest = numbered.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return max(least, math.isqrt(longest))


def blocks(numbered: DataFrame, size: int, fields: list[str]) -> DataFrame:
    """(conv, block, rows): at most ``size`` consecutive turns as structs (at, *fields); ``block`` is the first ``at``."""
    at = F.col("at")
    return (numbered.groupBy("conv", F.shiftright(at, 33).alias("_part"), F.floor(at.bitwiseAND(F.lit(_ROW)) / F.lit(size)).alias("_no"))
            .agg(F.array_sort(F.collect_list(F.struct("at", *fields))).alias("rows"))
            .select("conv", F.col("rows")[0]["at"].alias("block"), "rows"))
