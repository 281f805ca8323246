"""DBSCAN on cells of side eps / sqrt(features).

* Customers with equal features are merged first (weight = copies).
* Two points of a cell are always within eps.  Cells within eps of each other
  come from a median split with halo copies (``boxes.neighbour_cells``), so the
  work follows the occupied cells, in any number of features.
* A cell that holds min_samples with the cells wholly within eps is dense: all
  its points are core, without a look at any pair.  Only points of other, light
  cells (fewer than min_samples each) are compared with the points around.
* Dense cells are joined if their bounding boxes are wholly within eps or two
  of their outermost points are (``boxes.rim``).  Of the undecided pairs, those
  between different components are halved until some boxes decide
  (``boxes.refine``), so two dense cells that touch never meet point by point.
* Clusters are the components of the graph of core cells.  A border point takes
  the smallest adjacent cluster; clusters are numbered by their smallest core
  customer id (the reference's row order).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.operators import boxes as B
from cohortkit.operators.components import connected_components
from cohortkit.operators.ordering import global_positions
from cohortkit.session import cut, ensure_checkpoint_dir


BROADCAST_CELLS = 50_000  # counted tables of one row per cell go to every task up to here, so points are not exchanged to meet their cell


def _grid(df: DataFrame, feats: list[str], eps: float, id_col: str):
    """(customers, distinct points with their cell, cells, pairs of neighbouring cells, side of a cell).

    Customers are written first: a sum worked out twice may differ in its last bit, and they meet their point by equal features.
    """
    ensure_checkpoint_dir(df.sparkSession)
    side = eps / math.sqrt(len(feats))
    # 0.0 + x: a negative zero would fall into another box than zero
    pts = df.select(F.col(id_col).cast("string").alias("_id"), *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in feats]).transform(cut)
    points = (pts.dropna(subset=feats).groupBy(*feats).agg(F.count(F.lit(1)).alias("_w"), F.min("_id").alias("_pid"))
              .select("_pid", "_w", F.array(*feats).alias("_x")))
    points = points.withColumn("cell", B.box_of(F.col("_x"), side)).transform(cut)
    cells = B.boxes(points, F.col("cell"), len(feats)).transform(cut)
    near = B.neighbour_cells(cells, eps).transform(cut)
    return pts, points, cells, near, side


def _whole_weight(cells: DataFrame, near: DataFrame) -> DataFrame:
    """``cells`` with ``base``: weight of the cell and of the cells wholly within eps."""
    full = near.where("full").join(cells.select(F.col("box").alias("b"), F.col("w").alias("_wb")), "b").groupBy(
        F.col("a").alias("box")).agg(F.sum("_wb").alias("_more"))
    return cells.join(full, "box", "left").withColumn("base", F.col("w") + F.coalesce("_more", F.lit(0))).drop("_more")


def eps_neighbour_counts(df: DataFrame, feats: list[str], eps: float = 0.5, id_col: str = "customer_id",
                         few: int = B.FEW_PAIRS) -> DataFrame:
    """Per customer (null features: left out) the number of customers within ``eps``, itself included.

    Cells wholly within eps count as one number; undecided pairs are halved
    until their boxes are within or beyond eps or hold few points.
    """
    pts, points, cells, near, side = _grid(df, feats, eps, id_col)
    base = _whole_weight(cells, near).select(F.col("box").alias("cell"), "base")
    open_ = near.where(~F.col("full")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    more = B.refine(points, open_, len(feats), eps, side, count=True, few=few)
    n = (points.join(base, "cell").join(more, "_pid", "left")
         .select(*[F.col("_x")[i].alias(c) for i, c in enumerate(feats)], (F.col("base") + F.coalesce("add", F.lit(0))).alias("n_eps")))
    return pts.join(n, feats).select(F.col("_id").alias(id_col), F.col("n_eps").cast("bigint").alias("n_eps"))


def dbscan(df: DataFrame, feats: list[str], eps: float = 0.5, min_samples: int = 5,
           id_col: str = "customer_id", few: int = B.FEW_PAIRS) -> DataFrame:
    """Returns ``id_col``, ``segment`` ("Cluster i" or "Noise"), ``is_core``.

    A customer with a null feature has no place among the others and is Noise.
    """
    pts, points, cells, near, side = _grid(df, feats, eps, id_col)
    dims = len(feats)
    cells = _whole_weight(cells, near).withColumn("dense", F.col("base") >= min_samples).transform(cut)
    per_cell = F.broadcast if cells.count() <= BROADCAST_CELLS else lambda t: t
    flags = per_cell(cells.select(F.col("box").alias("cell"), "base", "dense"))
    points = points.join(flags, "cell").transform(cut)
    # points of light cells against the points of undecided neighbours: fewer than min_samples a cell
    part = near.where(~F.col("full")).select(F.col("a").alias("cell"), F.col("b").alias("other"))
    light = points.where(~F.col("dense"))
    around = (light.select("cell", F.col("_pid").alias("p"), F.col("_x").alias("px")).join(part, "cell")
              .join(points.select(F.col("cell").alias("other"), F.col("_pid").alias("q"), F.col("_x").alias("qx"), F.col("_w").alias("qw")), "other")
              .where(B.distance2(F.col("px"), F.col("qx"), dims) <= F.lit(eps * eps)).select("cell", "p", "other", "q", "qw").transform(cut))
    add = around.groupBy(F.col("p").alias("_pid")).agg(F.sum("qw").alias("_add"))
    points = points.join(add, "_pid", "left").withColumn(
        "core", F.col("dense") | (F.col("base") + F.coalesce("_add", F.lit(0)) >= min_samples)).select(
        "_pid", "_x", "_w", "cell", "dense", "core").transform(cut)
    core = points.where("core")
    core_cells = core.groupBy("cell").agg(F.min("_pid").alias("node"), F.first("dense").alias("dense")).transform(cut)
    sent = per_cell(core_cells)
    # edges of the graph of core cells
    both = (near.join(sent.select(F.col("cell").alias("a"), F.col("node").alias("na"), F.col("dense").alias("da")), "a")
            .join(sent.select(F.col("cell").alias("b"), F.col("node").alias("nb"), F.col("dense").alias("db")), "b")
            .where("na < nb").transform(cut))
    whole = both.where("full").select("na", "nb")
    met = (around.join(core.select(F.col("_pid").alias("p")), "p", "left_semi").join(core.select(F.col("_pid").alias("q")), "q", "left_semi")
           .select("cell", "other").distinct())
    node = sent.select("cell", "node")
    single = (met.join(node.withColumnRenamed("node", "na"), "cell").join(
        node.select(F.col("cell").alias("other"), F.col("node").alias("nb")), "other").select("na", "nb"))
    # two dense cells touch if two of their outermost points do
    undecided = both.where("NOT full AND da AND db")
    rims = per_cell(B.rim(points.where("dense"), F.col("cell"), dims).transform(cut))
    touch = (undecided.join(rims.select(F.col("box").alias("a"), F.col("x").alias("ax")), "a")
             .join(rims.select(F.col("box").alias("b"), F.col("x").alias("bx")), "b")
             .where(B.distance2(F.col("ax"), F.col("bx"), dims) <= F.lit(eps * eps)).select("na", "nb"))
    edges = whole.unionAll(single).unionAll(touch).select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct().transform(cut)
    comp = connected_components(edges)
    placed = core_cells.select("cell", "node").join(comp, "node", "left").select(
        "cell", F.coalesce("component", "node").alias("component")).transform(cut)
    # of the other pairs, only those between different components can change a cluster
    part_of = per_cell(placed)
    apart = (undecided.select(F.col("a").alias("u"), F.col("b").alias("v"))
             .join(part_of.select(F.col("cell").alias("u"), F.col("component").alias("cu")), "u")
             .join(part_of.select(F.col("cell").alias("v"), F.col("component").alias("cv")), "v").where("cu != cv").transform(cut))
    joined = B.refine(points.where("dense"), apart.select("u", "v"), dims, eps, side, count=False, few=few)
    links = apart.join(joined, ["u", "v"]).select(F.col("cu").alias("a"), F.col("cv").alias("b")).distinct().transform(cut)
    more = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("_joined"))
    placed = placed.join(more, "component", "left").select("cell", F.coalesce("_joined", "component").alias("component")).transform(cut)
    # the component is its smallest node, and a node the smallest core customer of its cell
    labels = per_cell(placed.select("cell", F.col("component").alias("_lab")))
    core_lab = core.select("_pid", "cell").join(labels, "cell").select("_pid", "_lab")
    border = points.where("NOT core").select("_pid", "cell")
    via_full = (border.join(near.where("full").select(F.col("a").alias("cell"), F.col("b").alias("other")), "cell")
                .join(labels.withColumnRenamed("cell", "other"), "other").select("_pid", "_lab"))
    via_point = (around.select(F.col("p").alias("_pid"), "other", "q").join(core.select(F.col("_pid").alias("q")), "q", "left_semi")
                 .join(border.select("_pid"), "_pid", "left_semi").join(labels.withColumnRenamed("cell", "other"), "other").select("_pid", "_lab"))
    reached = border.join(labels, "cell").select("_pid", "_lab").unionAll(via_full).unionAll(via_point).groupBy("_pid").agg(
        F.min("_lab").alias("_lab"))
    assigned = core_lab.unionAll(reached)
    numbered = global_positions(placed.select(F.col("component").alias("_lab")).distinct(), [F.col("_lab").asc()], pos_col="_num")
    lab = assigned.join(per_cell(numbered), "_lab").select("_pid", (F.col("_num") - 1).alias("_num"))
    per = points.join(lab, "_pid", "left").select(*[F.col("_x")[i].alias(c) for i, c in enumerate(feats)], "core", "_num")
    out = pts.join(per, feats, "left")
    return out.select(F.col("_id").alias(id_col),
                      F.when(F.col("_num").isNull(), F.lit("Noise"))
                      .otherwise(F.concat(F.lit("Cluster "), F.col("_num").cast("string"))).alias("segment"),
                      F.coalesce("core", F.lit(False)).alias("is_core"))
