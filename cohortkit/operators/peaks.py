"""F20 / J8 / F21 on feature columns, without a pair table.

Customers fall into cells of a grid, and occupied cells are the points from
then on: a cell has its members' mean, their number and its smallest
customer.  There are as many cells as the features' range holds, however many
customers there are, so after one aggregate nothing grows with the customers.

* Density (F20): members of all cells within reach, weighted by
  exp(-(distance / d_c)^2).  Cells within reach lie in neighbouring blocks of
  cells, and a block holds a fixed number of cells at most.
* Nearest denser point (J8) by expanding rings: a cell looks for a denser one
  within a radius; whoever finds one is done, as the nearest one lies inside
  the radius, and the others go on with twice the radius.  Who goes on is the
  densest within its radius, so few do, and far apart.
* Membership (F21): distances of customers to the k centres, which are
  broadcast.

Customers with a null feature have no place among the others and are left out.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.core import add_scalars
from cohortkit.operators.density import sample_customers
from cohortkit.session import cut

SAMPLE = 200           # customers whose pairs give d_c
REACH = 3.0            # of d_c: beyond it a member weighs less than 0.0002
KEY_DIMS = 3           # features that blocks of cells are made of; more only narrow the result down
BROADCAST_CELLS = 20_000


def cutoff_distance(df: DataFrame, feats: list[str], pct: float = 2.0, n: int = SAMPLE, seed: int = 42, id_col: str = "customer_id") -> float:
    """d_c: the ``pct`` percentile of all distances (both ways, zero diagonal) among ``n`` customers drawn by a seeded hash.

    Rounded to three digits, 0.001 at least, so that equal customers do not make it zero.
    """
    x = np.array([tuple(r) for r in sample_customers(df.dropna(subset=feats), n, seed, id_col).select(*feats).collect()], dtype=float)
    if not len(x):
        return 0.001
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    return max(math.floor(float(np.quantile(d, pct / 100.0)) * 1000 + 0.5) / 1000, 0.001)


def _cells(df: DataFrame, feats: list[str], side: float, id_col: str) -> DataFrame:
    keys = [F.floor(F.col(f) / F.lit(side)).alias(f"g{i}") for i, f in enumerate(feats)]
    return df.dropna(subset=feats).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(id_col).alias("id"), *[F.avg(f).alias(f"c{i}") for i, f in enumerate(feats)])


def _near(a: DataFrame, b: DataFrame, dims: int, radius: float, side: float, small: bool = False) -> DataFrame:
    """Rows of ``a`` with those of ``b`` (both cells, prefixes a_ and b_) within ``radius``, and their distance ``d``."""
    wide = math.floor(radius / side) + 1  # cells within the radius are at most this many cells apart
    keyed = range(min(dims, KEY_DIMS))
    a = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], *[F.floor(F.col(f"g{i}") / F.lit(wide)).alias(f"k{i}") for i in keyed])
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(step)])
                      for step in itertools.product((-1, 0, 1), repeat=len(keyed))])
    a = a.withColumn("_s", F.explode(steps)).select("*", *[(F.floor(F.col(f"a_g{i}") / F.lit(wide)) + F.col(f"_s.s{i}")).alias(f"k{i}")
                                                           for i in keyed]).drop("_s")
    d = F.sqrt(sum(((F.col(f"a_c{i}") - F.col(f"b_c{i}")) ** 2 for i in range(dims)), F.lit(0.0)))
    joined = b.join(F.broadcast(a) if small else a, [f"k{i}" for i in keyed])
    return joined.withColumn("d", d).where(F.col("d") <= F.lit(radius))


def cell_densities(df: DataFrame, feats: list[str], dc: float, side: float | None = None, id_col: str = "customer_id") -> DataFrame:
    """Occupied cells: g*, c* (mean), n, id (smallest customer), rho (rounded to six digits)."""
    side = side or dc
    cells = _cells(df, feats, side, id_col).transform(cut)
    near = _near(cells, cells, len(feats), REACH * dc, side)
    rho = near.groupBy(F.col("a_id").alias("id")).agg(
        F.round(F.sum(F.col("b_n") * F.exp(-F.pow(F.col("d") / F.lit(dc), F.lit(2.0)))), 6).alias("rho"))
    return cells.join(rho, "id").transform(cut)


def nearest_denser(cells: DataFrame, dims: int, radius: float, side: float) -> DataFrame:
    """(id, delta): J8 for every cell but the densest.  Ties of density go to the smaller id."""
    open_ = cells.select("id", "rho", *[f"g{i}" for i in range(dims)], *[f"c{i}" for i in range(dims)])
    found, n = None, cells.count()
    denser = (F.col("b_rho") > F.col("a_rho")) | ((F.col("b_rho") == F.col("a_rho")) & (F.col("b_id") < F.col("a_id")))
    while n > 1:
        near = _near(open_, cells, dims, radius, side, small=n <= BROADCAST_CELLS)
        got = near.where(denser).groupBy(F.col("a_id").alias("id")).agg(F.min("d").alias("delta")).transform(cut)
        found = got if found is None else found.unionAll(got)
        open_ = open_.join(got, "id", "left_anti").transform(cut)
        n, radius = open_.count(), 2 * radius
    return found if found is not None else cells.select("id", F.lit(0.0).alias("delta")).limit(0)


def density_peaks(df: DataFrame, feats: list[str], k: int, dc: float | None = None, id_col: str = "customer_id") -> DataFrame:
    """F20 per customer: id, rho, delta, gamma = rho * delta, center_rank (1..k for the k largest gamma, else null).

    A customer has its cell's density; the smallest one of a cell stands for it
    and has its delta, the others lie on a denser point: 0.
    The densest cell takes the largest delta.
    """
    dc = dc or cutoff_distance(df, feats, id_col=id_col)
    cells = cell_densities(df, feats, dc, id_col=id_col)
    delta = nearest_denser(cells, len(feats), REACH * dc, dc).transform(cut)
    top = delta.agg(F.coalesce(F.max("delta"), F.lit(0.0)).alias("_top"))
    cells = add_scalars(cells.join(delta, "id", "left"), top).select(
        *[f"g{i}" for i in range(len(feats))], F.col("id").alias("_first"), "rho", F.coalesce("delta", "_top").alias("_delta"))
    keys = [F.floor(F.col(f) / F.lit(dc)).alias(f"g{i}") for i, f in enumerate(feats)]
    rows = df.dropna(subset=feats).select(F.col(id_col).alias("id"), *keys).join(cells, [f"g{i}" for i in range(len(feats))])
    out = rows.select("id", "rho", F.when(F.col("id") == F.col("_first"), F.col("_delta")).otherwise(F.lit(0.0)).alias("delta"))
    out = out.withColumn("gamma", F.col("rho") * F.col("delta")).transform(cut)
    best = out.orderBy(F.desc("gamma"), "id").limit(k)  # k rows: the feature
    ranked = best.select("id", F.row_number().over(Window.orderBy(F.desc("gamma"), "id")).alias("center_rank"))
    return out.join(F.broadcast(ranked), "id", "left")


def fuzzy_membership(df: DataFrame, feats: list[str], peaks: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """(id, center_rank, membership) of every customer in every centre of ``density_peaks``.

    f_ic = (1 / (d_ic + 1e-9))^0.5, divided by its sum over the centres; the k centres are broadcast.
    """
    x = df.dropna(subset=feats).select(F.col(id_col).alias("id"), *[F.col(f).alias(f"x{i}") for i, f in enumerate(feats)])
    centres = peaks.where(F.col("center_rank").isNotNull()).select("id", "center_rank").join(x, "id").select(
        "center_rank", *[F.col(f"x{i}").alias(f"c{i}") for i in range(len(feats))])
    d = F.sqrt(sum(((F.col(f"x{i}") - F.col(f"c{i}")) ** 2 for i in range(len(feats))), F.lit(0.0)))
    each = x.join(F.broadcast(centres)).withColumn("f", F.pow(F.lit(1.0) / (d + F.lit(1e-9)), F.lit(0.5)))
    per = F.array_sort(F.collect_list(F.struct("center_rank", "f")))  # k of them
    total = F.aggregate("m", F.lit(0.0), lambda s, m: s + m["f"])
    return (each.groupBy("id").agg(per.alias("m")).select("id", total.alias("t"), F.explode("m").alias("m"))
            .select("id", F.col("m.center_rank").alias("center_rank"), (F.col("m.f") / F.col("t")).alias("membership")))
