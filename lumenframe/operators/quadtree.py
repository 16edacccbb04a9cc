"""Nearest points in crowded images by a quadtree in tables.

Objects at one place are one point, of which only the first few indexes matter.  Cells of
an image are split by count, level by level, each with the bounds of its points.  All
points then search the tree at once, a level at a time: a point keeps the cells that may
hold one of its nearest, given how far away enough points surely are.  What is left are
leaves of few points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_table
from ..sources.spread import split_join

#: A cell of no more rows is a leaf; at the last level every cell is one.
LEAF, LEVELS = 32, 31
_BOUNDS = ("_x0", "_x1", "_y0", "_y1")
_CELL = ["image_id", "_i", "_j"]


def _bounds(x: str, y: str) -> list[Column]:
    return [F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")]


def build(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(cells of each level, leaf rows) of rows (image_id, b, b_ux, b_uy).

    cells: image_id, _i, _j, _n, _leaf and bounds; a leaf row has the level and cell of
    its leaf."""
    span = rows.groupBy("image_id").agg(*_bounds("b_ux", "b_uy"))
    unit = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    place = lambda c, low: F.when(unit > 0, F.least(F.floor((F.col(c) - F.col(low)) / unit * (1 << LEVELS)), F.lit((1 << LEVELS) - 1))).otherwise(0).cast("long")
    placed = rows.join(span.hint("merge"), "image_id").select("image_id", "b", "b_ux", "b_uy", place("b_ux", "_x0").alias("_gi"), place("b_uy", "_y0").alias("_gj"))
    todo = scratch_table(placed, "points")
    cells, leaves = [], []
    for level in range(LEVELS + 1):
        at = todo.withColumns({"_i": F.shiftright("_gi", LEVELS - level), "_j": F.shiftright("_gj", LEVELS - level)})
        found = at.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_n"), *_bounds("b_ux", "b_uy"))
        found = scratch_table(found.withColumn("_leaf", (F.col("_n") <= LEAF) | F.lit(level == LEVELS)), f"cells_{level}")
        cells.append(found)
        told = scratch_table(split_join(at, found.select(*_CELL, "_leaf"), _CELL, F.col("b")), f"points_{level}")
        leaves.append(told.where("_leaf").select(F.lit(level).alias("_level"), *_CELL, "b", "b_ux", "b_uy"))
        todo = told.where("not _leaf").select(*todo.columns)
        if todo.isEmpty():
            break
    return cells, reduce(DataFrame.unionByName, leaves)


def _far(q: str, low: str, high: str) -> Column:
    d = F.greatest(F.col(q) - F.col(low), F.col(high) - F.col(q))
    return d * d


def _near(q: str, low: str, high: str) -> Column:
    d = F.greatest(F.col(low) - F.col(q), F.col(q) - F.col(high), F.lit(0.0))
    return d * d


def search(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """image_id, ux, uy, b, dist2, place: the k rows nearest to each asked point
    (image_id, ux, uy; distinct), ties by b.  rows (image_id, b, b_ux, b_uy)."""
    cells, leaves = build(rows)
    point = ["image_id", "ux", "uy"]
    by_point, by_far = Window.partitionBy(*point), Window.partitionBy(*point).orderBy("_far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = F.xxhash64("ux", "uy")

    def pruned(front: DataFrame, name: str) -> DataFrame:
        far, near = _far("ux", "_x0", "_x1") + _far("uy", "_y0", "_y1"), _near("ux", "_x0", "_x1") + _near("uy", "_y0", "_y1")
        seen = front.withColumns({"_far": far, "_near": near}).withColumn("_sum", F.sum("_n").over(by_far))
        reach = F.coalesce(F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(by_point), F.lit(float("inf")))
        return scratch_table(seen.withColumn("_reach", reach).where(F.col("_near") <= F.col("_reach") * (1 + 1e-9)).select(*front.columns), name)

    root = cells[0].select("image_id", "_i", "_j", "_n", "_leaf", *_BOUNDS, F.lit(0).alias("_level"))
    front = pruned(split_join(asked.select(*point), root, ["image_id"], spread), "front_0")
    for level, below in enumerate(cells[1:], 1):
        half = lambda c: F.shiftright(c, 1).alias(c.replace("_", "_p"))
        child = below.select("image_id", half("_i"), half("_j"), *_CELL[1:], "_n", "_leaf", *_BOUNDS, F.lit(level).alias("_level"))
        going = front.where("not _leaf").select(*point, F.col("_i").alias("_pi"), F.col("_j").alias("_pj"))
        opened = split_join(going, child, ["image_id", "_pi", "_pj"], spread).select(*front.columns)
        front = pruned(front.where("_leaf").unionByName(opened), f"front_{level}")
    met = split_join(front.select(*point, "_level", "_i", "_j"), leaves, ["image_id", "_level", "_i", "_j"], spread)
    dx, dy = F.col("b_ux") - F.col("ux"), F.col("b_uy") - F.col("uy")
    near = met.select(*point, "b", (dx * dx + dy * dy).alias("dist2"))
    rank = F.row_number().over(Window.partitionBy(*point).orderBy("dist2", "b"))
    return near.withColumn("place", rank).where(F.col("place") <= k)


def nearest_in_crowds(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """image_id, a, b, dist2, rank: the k nearest others of each row of a, ties by index.

    a (image_id, a, a_ux, a_uy) and b (image_id, b, b_ux, b_uy) are the same objects, and
    each image has more than k of them.  Where more than k share a place, they are each
    other's nearest, and no search is made."""
    at = lambda s: [F.col(f"{s}_ux").alias("ux"), F.col(f"{s}_uy").alias("uy")]
    point = ["image_id", "ux", "uy"]
    first = Window.partitionBy("image_id", "b_ux", "b_uy").orderBy("b")
    # the rank limit acts before the shuffle as well: a crowd at one place costs a few rows a task
    rows = b.select("image_id", "b", "b_ux", "b_uy").withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k + 1).drop("_nth")
    rows = scratch_table(rows, "firsts")
    points = rows.groupBy("image_id", "b_ux", "b_uy").agg(F.count(F.lit(1)).alias("_c"), F.array_sort(F.collect_list("b")).alias("_all"))
    points = scratch_table(points.select("image_id", *at("b"), "_c", "_all"), "places")
    here = points.where(F.col("_c") > k).select(*point, F.transform("_all", lambda x: F.struct(F.lit(0.0).alias("dist2"), x.alias("b"))).alias("near"))
    asked = points.where(F.col("_c") <= k)
    found = search(asked, rows, k + 1).groupBy(*point).agg(F.array_sort(F.collect_list(F.struct("dist2", "b"))).alias("near"))
    objects = a.select("image_id", "a", *at("a"))
    met = split_join(objects, scratch_table(here.unionByName(found), "near"), point, F.col("a"))
    others = F.slice(F.filter("near", lambda n: n["b"] != F.col("a")), 1, k)
    out = met.select("image_id", "a", F.posexplode(others).alias("_p", "_n"))
    return out.select("image_id", "a", "_n.b", "_n.dist2", (F.col("_p") + 1).alias("rank"))
