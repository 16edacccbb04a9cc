"""Pairs of objects within an image: overlaps, neighbours, dedup and matching (JN)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..sources.scratch import scratch_table
from ..sources.spread import split_join
from .quadtree import nearest_in_crowds

BOX = ("x1", "y1", "x2", "y2")
#: Objects of an image that all meet each other: a bounded group of pairs.
DENSE = 64


def _sides(df: DataFrame, cols: list[str], left: str = "a", right: str = "b") -> tuple[DataFrame, DataFrame]:
    side = lambda t: df.select("image_id", F.col("obj_idx").alias(t), *[F.col(c).alias(f"{t}_{c}") for c in cols])
    return side(left), side(right)


def tiled(boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A row for each tile that a box touches, as equi-join keys for wide images."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cfg.tile), F.floor((F.col(hi) - 1) / cfg.tile))
    solid = boxes.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return solid.select("*", F.explode(span("x1", "x2")).alias("tx")).select("*", F.explode(span("y1", "y2")).alias("ty"))


def overlapping_boxes(boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Ordered pairs (a, b) of an image whose boxes share an interior, each once.

    Boxes meet by tile; a pair counts in the tile that holds the upper left corner of
    its intersection, so no distinct is needed."""
    t = tiled(boxes, cfg)
    side = lambda k: t.select("image_id", "tx", "ty", F.col("obj_idx").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in BOX])
    p = side("a").join(side("b"), ["image_id", "tx", "ty"]).where("a <> b")
    x1, y1 = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    p = p.where((x1 < F.least("a_x2", "b_x2")) & (y1 < F.least("a_y2", "b_y2")))
    return p.where((F.floor(x1 / cfg.tile) == F.col("tx")) & (F.floor(y1 / cfg.tile) == F.col("ty"))).drop("tx", "ty")


def _box_iou(p: Callable[[str], Column], q: Callable[[str], Column]) -> Column:
    iw = F.least(p("x2"), q("x2")) - F.greatest(p("x1"), q("x1"))
    ih = F.least(p("y2"), q("y2")) - F.greatest(p("y1"), q("y1"))
    area = lambda s: (s("x2") - s("x1")) * (s("y2") - s("y1"))
    return F.when((iw <= 0) | (ih <= 0), 0.0).otherwise(iw * ih / (area(p) + area(q) - iw * ih + F.lit(1e-8)))


def box_iou(left: str = "a", right: str = "b") -> Column:
    """IoU of the boxes a_x1.. and b_x1..; 0 for disjoint or touching boxes."""
    return _box_iou(lambda c: F.col(f"{left}_{c}"), lambda c: F.col(f"{right}_{c}"))


def box_iou_pairs(boxes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """JN-03: image_id, a, b, iou of every ordered pair with a positive IoU."""
    return overlapping_boxes(boxes, cfg).select("image_id", "a", "b", box_iou().alias("iou"))


def mask_iou_pairs(words: DataFrame, eps: float = 0.0) -> DataFrame:
    """JN-02: image_id, a, b, inter, iou of every ordered pair of masks that share a pixel.

    Masks meet by (image, row, tile), where they share 32 pixels, for a < b only; bitwise
    counts sum up to one row per pair, which then gives the mirrored pair too.  All keys
    hold image_id: of words dealt by it, no row is moved or written."""
    ext = words.groupBy("image_id", "obj_idx").agg(F.sum(F.bit_count("bits")).alias("area"))
    side = lambda k: words.select("image_id", "py", "tx", F.col("obj_idx").alias(k), F.col("bits").alias(f"{k}_bits"))
    met = side("a").join(side("b").hint("merge"), ["image_id", "py", "tx"]).where("a < b")
    shared = F.bit_count(F.col("a_bits").bitwiseAND(F.col("b_bits")))
    inter = met.groupBy("image_id", "a", "b").agg(F.sum(shared).alias("inter")).where("inter > 0")
    area = lambda k: ext.select("image_id", F.col("obj_idx").alias(k), F.col("area").alias(f"{k}_area"))
    sized = inter.join(area("a").hint("merge"), ["image_id", "a"]).join(area("b").hint("merge"), ["image_id", "b"])
    ways = [F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(f"{p}_area").alias("a_area"), F.col(f"{q}_area").alias("b_area")) for p, q in ("ab", "ba")]
    out = sized.select("image_id", "inter", F.inline(F.array(*ways)))
    union = F.col("a_area") + F.col("b_area") - F.col("inter")
    return out.select("image_id", "a", "b", "inter", (F.col("inter") / (union + F.lit(eps))).alias("iou"))


def dedup_masks(objects: DataFrame, words: DataFrame, primary: str = "GroundedSAM2", candidate: str = "SAM2_AMG", cfg: Config = DEFAULT) -> DataFrame:
    """JN-04, ST-01: primaries, then the candidates that match no primary; adds origin.

    Masks without pixels are dropped.  Only candidates meet primaries, and of those only
    pairs whose bounds allow the threshold: the smaller area, and the overlap of both
    extents, are at least the threshold times the larger area.  Bits are counted for the
    pairs that are left (see mask_bounds).  All keys hold image_id, as in mask_iou_pairs."""
    ext = mask_bounds(words)
    solid = objects.join(ext.select("image_id", "obj_idx"), ["image_id", "obj_idx"], "left_semi")
    first, second = solid.where(F.col("segmentor") == primary), solid.where(F.col("segmentor") == candidate)
    pair = threshold_pairs(ext.where(F.col("segmentor") == candidate), ext.where(F.col("segmentor") == primary), cfg)
    side = lambda k, name: words.where(F.col("segmentor") == name).select("image_id", "py", "tx", F.col("obj_idx").alias(k), F.col("bits").alias(f"{k}_bits"))
    a = side("a", candidate).join(pair.hint("merge"), ["image_id", "a"])
    met = a.join(side("b", primary).hint("merge"), ["image_id", "b", "py", "tx"])
    inter = met.groupBy("image_id", "a", "b", "a_area", "b_area").agg(F.sum(F.bit_count(F.col("a_bits").bitwiseAND(F.col("b_bits")))).alias("inter"))
    hit = inter.where(F.col("inter") / (F.col("a_area") + F.col("b_area") - F.col("inter")) >= cfg.dedup_iou)
    victims = hit.select("image_id", F.col("a").alias("obj_idx")).distinct()
    rest = second.join(victims, ["image_id", "obj_idx"], "left_anti")
    return first.withColumn("origin", F.lit("primary")).unionByName(rest.withColumn("origin", F.lit("survivor")))


def mask_bounds(words: DataFrame) -> DataFrame:
    """Area and extents (x1, y1, x2, y2; half open, in whole tiles of words along a row)
    of each mask."""
    tile = F.lit(32)
    return words.groupBy("image_id", "obj_idx", "segmentor").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("area"), F.min(F.col("tx") * tile).alias("x1"), F.min("py").alias("y1"), (F.max("tx") * tile + tile).alias("x2"), (F.max("py") + 1).alias("y2")
    )


def threshold_pairs(a: DataFrame, b: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """image_id, a, b and areas of the pairs of masks (see mask_bounds) whose IoU may reach
    dedup_iou: IoU is at most smaller area / larger area, and at most what their extents
    share / larger area.  Extents meet by tile; cfg.dedup_iou is above 0."""
    t, cut = cfg.tile, cfg.dedup_iou
    cols = ["x1", "y1", "x2", "y2", "area"]
    one = a.select("image_id", F.col("obj_idx").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    two = b.select("image_id", F.col("obj_idx").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / t), F.floor((F.col(hi) - 1) / t)))
    tiles = lambda df, k: df.withColumn("_i", span(f"{k}_x1", f"{k}_x2")).withColumn("_j", span(f"{k}_y1", f"{k}_y2"))
    met = tiles(one, "a").join(tiles(two, "b"), ["image_id", "_i", "_j"])
    x, y = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    w, h = F.least("a_x2", "b_x2") - x, F.least("a_y2", "b_y2") - y
    most, least = F.greatest("a_area", "b_area"), F.least("a_area", "b_area", w * h)
    # a pair counts in the tile of the upper left corner of what the extents share
    ok = (w > 0) & (h > 0) & (F.floor(x / t) == F.col("_i")) & (F.floor(y / t) == F.col("_j")) & (least >= most * (cut - 1e-9))
    return met.where(ok).select("image_id", "a", "b", "a_area", "b_area")


def match_by_detection(detections: DataFrame, masks: DataFrame) -> DataFrame:
    """JN-05: each detection with the mask of its index; a bad index gives -1, area 0."""
    m = masks.select("image_id", "mask_index", F.col("mask_index").alias("found"), "area")
    d = detections.join(m, ["image_id", "mask_index"], "left")
    return d.select("image_id", "obj_idx", F.coalesce("found", F.lit(-1)).alias("sam2_mask_index"), F.coalesce("area", F.lit(0)).alias("area"))


def match_by_mask(masks: DataFrame, detections: DataFrame) -> DataFrame:
    """JN-06: every mask, with the detection of its index or a generic label."""
    d = detections.select("image_id", F.col("mask_index"), "obj_idx", "label")
    j = masks.join(d, ["image_id", "mask_index"], "left")
    return j.select(
        "image_id",
        "mask_index",
        F.coalesce("label", F.lit("unlabeled")).alias("label"),
        F.when(F.col("obj_idx").isNull(), F.format_string("obj_%d_mask", "mask_index")).otherwise(F.format_string("obj_%d_GroundedSAM2", "obj_idx")).alias("id"),
    )


def _ranked(p: DataFrame, k: int) -> DataFrame:
    """Pairs with dist2 and the rank of b among the neighbours of a, up to k."""
    dx, dy = F.col("b_ux") - F.col("a_ux"), F.col("b_uy") - F.col("a_uy")
    p = p.withColumn("dist2", dx * dx + dy * dy)
    rank = F.row_number().over(Window.partitionBy("image_id", "a").orderBy("dist2", "b"))
    return p.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(objects: DataFrame, cfg: Config = DEFAULT, cols: tuple[str, ...] = ()) -> DataFrame:
    """JN-07, TK-02: the k nearest objects by centroid (ux, uy), ties by index.

    In an image of no more than DENSE objects all meet; a larger one goes by a quadtree,
    so that a crowded image, or a crowd at one place, is no group of pairs."""
    k = cfg.neighbours
    a, b = _sides(objects, ["ux", "uy", *cols])
    size = objects.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    few = size.where(F.col("_n") <= max(DENSE, k)).select("image_id")
    some = a.join(few, "image_id", "left_semi").join(b, "image_id").where("a <> b")
    out = _ranked(some, k)
    many = scratch_table(size.where(F.col("_n") > max(DENSE, k)).select("image_id"), "crowded")
    if many.isEmpty():
        return out
    a = scratch_table(split_join(a, many, ["image_id"], F.col("a"), "left_semi"), "crowd")
    b = a.select("image_id", *[F.col(c).alias(f"b{c[1:]}") for c in a.columns if c != "image_id"])
    near = nearest_in_crowds(a, b, k)
    met = split_join(split_join(near, a, ["image_id", "a"], F.col("rank")), b, ["image_id", "b"], F.col("a"))
    return out.unionByName(met.select(*out.columns))


def semantic_gate(ious: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """JN-08: all ordered pairs whose masks overlap enough go on to a scorer."""
    return ious.where(F.col("iou") >= cfg.semantic_iou).select("image_id", "a", "b")


def with_category(df: DataFrame, label: str, categories: DataFrame) -> DataFrame:
    """JN-11: category_id by name; 80 categories are broadcast."""
    c = F.broadcast(categories.select(F.col("id").alias("category_id"), F.lower("name").alias("_name")))
    return df.join(c, F.lower(F.col(label)) == F.col("_name"), "left").drop("_name")


def compare_tracks(nodes: DataFrame, tracks: tuple[str, str] = ("GroundedSAM2", "SAM3")) -> DataFrame:
    """JN-14: per image, the number of objects and their mean confidence in each track."""

    def side(name: str, tag: str) -> DataFrame:
        return nodes.where(F.col("segmentor") == name).groupBy("image_id").agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), (F.sum("conf_pct") / F.count(F.lit(1))).alias(f"conf_{tag}")
        )

    j = side(tracks[0], "a").join(side(tracks[1], "b"), "image_id", "full")
    none = F.lit(0).cast("long")
    return j.select("image_id", F.coalesce("n_a", none).alias("n_a"), F.coalesce("n_b", none).alias("n_b"), "conf_a", "conf_b")
