"""Spatial and semantic relations, and triplets attached to objects (SC-09..11, JN-09..13, PL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.labels import external_id, external_label
from ..sources.scratch import scratch_table
from ..sources.spread import split_join
from .pairs import box_iou, nearest

#: Needles times labels of an image that may all meet.
MEET = 4096


def direction() -> Column:
    """By the larger difference of the centroids; the horizontal one wins ties."""
    dx, dy = F.col("b_ux") - F.col("a_ux"), F.col("b_uy") - F.col("a_uy")
    return F.when(F.abs(dx) >= F.abs(dy), F.when(dx > 0, "left_of").otherwise("right_of")).when(dy > 0, "above").otherwise("below")


def box_predicate(iou: Column, cfg: Config = DEFAULT) -> Column:
    """SC-10."""
    return F.when(iou >= cfg.box_overlap, "overlapping").otherwise(direction())


def mask_predicate(iou: Column, cfg: Config = DEFAULT) -> Column:
    """SC-09; depths are a_z and b_z in millimetres, null if unknown."""
    dz = F.col("b_z") - F.col("a_z")
    far = F.abs(dz) >= cfg.depth_far_mm
    return (
        F.when(F.coalesce(iou, F.lit(0.0)) >= cfg.mask_overlap, "overlapping")
        .when(far, F.when(F.col("a_z") < F.col("b_z"), "in_front_of").otherwise("behind"))
        .otherwise(direction())
    )


def relation_score(pred: Column) -> Column:
    """SC-11."""
    return F.when(pred == "overlapping", 0.85).when(pred.isin("in_front_of", "behind"), 0.75).otherwise(0.70)


def box_scaffold(boxes: DataFrame, cfg: Config = DEFAULT, iou: Callable[[], Column] = box_iou) -> DataFrame:
    """Relations of each object to its nearest ones from boxes only.  UD-01: iou is any
    function that gives a column for the pair a_x1.., b_x1.. ."""
    n = nearest(boxes, cfg, ("x1", "y1", "x2", "y2"))
    n = n.withColumn("predicate", box_predicate(iou(), cfg))
    return n.select("image_id", F.col("a").alias("sub_idx"), F.col("b").alias("obj_idx"), "rank", "predicate", relation_score(F.col("predicate")).alias("score"))


def mask_scaffold(objects: DataFrame, ious: DataFrame, cfg: Config = DEFAULT, iou: Callable[[], Column] = box_iou) -> DataFrame:
    """Relations from masks: objects (image_id, obj_idx, x1.., ux, uy, z, masked), ious of
    pairs of masks.  Neighbours are ranked by ux, uy, which are the mask's centroid where
    there is one; a pair without any mask is told by its boxes."""
    n = nearest(objects, cfg, ("z", "masked", "x1", "y1", "x2", "y2")).join(ious.select("image_id", "a", "b", F.col("iou").alias("_iou")), ["image_id", "a", "b"], "left")
    by_mask = F.col("a_masked") | F.col("b_masked")
    n = n.withColumn("predicate", F.when(by_mask, mask_predicate(F.col("_iou"), cfg)).otherwise(box_predicate(iou(), cfg)))
    return n.select("image_id", F.col("a").alias("sub_idx"), F.col("b").alias("obj_idx"), "rank", "predicate", relation_score(F.col("predicate")).alias("score"))


def with_semantic(spatial: DataFrame, semantic: DataFrame, counts: DataFrame, enabled: bool = True) -> DataFrame:
    """ST-02: both layers as a bag; the semantic one needs two objects in the image."""
    layer = lambda d, name: d.withColumn("source_layer", F.lit(name))
    if not enabled:
        return layer(spatial, "spatial")
    some = counts.where(F.col("n_objects") >= 2).select("image_id")
    return layer(spatial, "spatial").unionByName(layer(semantic.join(some, "image_id", "left_semi"), "semantic"))


def prefer_precomputed(precomputed: DataFrame, computed: DataFrame) -> DataFrame:
    """PL-02: an image with precomputed triplets has only those."""
    rest = computed.join(precomputed.select("image_id").distinct(), "image_id", "left_anti")
    return precomputed.unionByName(rest, allowMissingColumns=True)


def _pieces(text: Column, sizes: Column) -> Column:
    """All different substrings of a text that have one of the sizes."""
    some = F.filter(sizes, lambda n: n <= F.char_length(text))
    starts = lambda n: F.when(n == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.char_length(text) - n + 1))
    return F.array_distinct(F.flatten(F.transform(some, lambda n: F.transform(starts(n), lambda i: F.substring(text, i, n)))))


def _indexed_labels(needles: DataFrame, labels: DataFrame) -> DataFrame:
    """image_id, needle, idx of needles and labels (image_id, label, idx; both distinct)
    by a substring index: the pieces of the labels, of those sizes that the image's
    needles have, with the first object of each; and the same the other way round.
    Every needle is one look-up, however many labels hold it."""

    def pieces(texts: DataFrame, col: str, others: DataFrame, other: str) -> DataFrame:
        sizes = others.groupBy("image_id").agg(F.collect_set(F.char_length(other)).alias("_sizes"))
        met = split_join(texts, sizes, ["image_id"], F.xxhash64(col))
        return met.select(*texts.columns, F.explode(_pieces(F.col(col), F.col("_sizes"))).alias("_piece"))

    held = pieces(labels, "label", needles, "needle").groupBy("image_id", F.col("_piece").alias("needle")).agg(F.min("idx").alias("idx"))
    inside = needles.join(held.hint("merge"), ["image_id", "needle"])
    parts = pieces(needles, "needle", labels, "label").withColumnRenamed("_piece", "label")
    around = split_join(parts, labels, ["image_id", "label"], F.xxhash64("needle"))
    both = inside.select("image_id", "needle", "idx").unionByName(around.select("image_id", "needle", "idx"))
    return both.groupBy("image_id", "needle").agg(F.min("idx").alias("idx"))


def first_by_label(needles: DataFrame, objects: DataFrame) -> DataFrame:
    """needles (image_id, needle; distinct, not empty) with idx, the first object whose
    lower-cased label holds the needle, or is held by it.

    In an image of few needles and labels all meet; a larger one goes by an index.  Give
    tables at rest, dealt by image_id if possible: then nothing is moved for small images."""
    labels = objects.where("label is not null").groupBy("image_id", F.lower("label").alias("label")).agg(F.min("obj_idx").alias("idx"))
    count = lambda df, name: df.groupBy("image_id").agg(F.count(F.lit(1)).alias(name))
    size = count(needles, "_n").join(count(labels, "_m").hint("merge"), "image_id").where(F.col("_n") * F.col("_m") > MEET)
    large = scratch_table(size.select("image_id"), "large_images")
    if none := large.isEmpty():
        few, some = needles, labels
    else:
        needles, labels = scratch_table(needles, "needles"), scratch_table(labels, "labels")
        few, some = (x.join(large, "image_id", "left_anti") for x in (needles, labels))
    hit = few.join(some.hint("merge"), "image_id").where(F.col("label").contains(F.col("needle")) | F.col("needle").contains(F.col("label")))
    out = hit.groupBy("image_id", "needle").agg(F.min("idx").alias("idx"))
    if none:
        return out
    return out.unionByName(_indexed_labels(*(split_join(x, large, ["image_id"], F.xxhash64(c), "left_semi") for x, c in ((needles, "needle"), (labels, "label")))))


def resolve(triplets: DataFrame, objects: DataFrame) -> DataFrame:
    """JN-09, JN-10: subject and target of each triplet as object indexes.

    An id wins; else the first object by label.  Adds s_idx, s_by, t_idx, t_by, where by
    is id, label or null.  objects(image_id, obj_idx, id, label).  Every key holds
    image_id, so that tables dealt by it are not moved."""
    t = triplets.withColumns({"_sub": F.lower(F.trim("sub")), "_obj": F.lower(F.trim("obj"))})
    ids = objects.select("image_id", F.col("obj_idx").alias("_idx"), F.col("id").alias("_id"))
    for side, id_col in (("s", "sub_id"), ("t", "obj_id")):
        t = t.join(ids.select("image_id", F.col("_idx").alias(f"_{side}_id"), F.col("_id").alias(id_col)).hint("merge"), ["image_id", id_col], "left")
    lost = t.select("image_id", F.explode(F.array(F.when(F.col("_s_id").isNull(), F.col("_sub")), F.when(F.col("_t_id").isNull(), F.col("_obj")))).alias("needle"))
    found = first_by_label(lost.where("needle <> ''").distinct(), objects)
    for side, needle in (("s", "_sub"), ("t", "_obj")):
        t = t.join(found.select("image_id", F.col("needle").alias(needle), F.col("idx").alias(f"_{side}_label")).hint("merge"), ["image_id", needle], "left")
        by_id, by_label = F.col(f"_{side}_id"), F.when(F.col(f"_{side}_id").isNull(), F.col(f"_{side}_label"))
        t = t.withColumns({f"{side}_by": F.when(by_id.isNotNull(), "id").when(by_label.isNotNull(), "label"), f"{side}_idx": F.coalesce(by_id, by_label)})
    return t


#: Fixed order: whose caption of a target counts, if it is not empty.
CAPTIONS = ("caption", "rampp_caption", "florence2_caption")


def attach(triplets: DataFrame, objects: DataFrame) -> DataFrame:
    """JN-09..10: relation rows.  Triplets without a subject are dropped; a target that
    is no object is external.  objects has id, label, and captions of the labellers:
    caption (of the segmentor), rampp_caption, florence2_caption; those it lacks are
    empty."""
    r = resolve(triplets, objects).where(F.col("s_idx").isNotNull())
    told = [F.nullif(F.col(c), F.lit("")) for c in CAPTIONS if c in objects.columns]
    o = objects.select("image_id", F.col("obj_idx").alias("t_idx"), F.col("id").alias("_tid"), F.col("label").alias("_tl"), F.coalesce(*told, F.lit("")).alias("_tc"))
    s = objects.select("image_id", F.col("obj_idx").alias("s_idx"), F.col("id").alias("source_id"))
    r = r.join(o.hint("merge"), ["image_id", "t_idx"], "left").join(s.hint("merge"), ["image_id", "s_idx"])
    target = F.coalesce("_tid", external_id(F.col("obj")))
    return r.select(
        "image_id",
        "seq",
        "source_id",
        F.coalesce("pred", F.lit("related_to")).alias("predicate"),
        target.alias("target_id"),
        F.coalesce("_tl", external_label(target)).alias("target_label"),
        F.coalesce("_tc", F.lit("")).alias("target_caption"),
        F.bround("score", 4).alias("score"),
    )


def attach_counts(triplets: DataFrame, objects: DataFrame) -> DataFrame:
    """AG-14: the eight counters, per image."""
    r = resolve(triplets, objects)
    has = F.col("s_idx").isNotNull()
    return r.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("input_triplets"),
        F.count_if(has).alias("attached"),
        F.count_if(F.col("s_by") == "id").alias("subject_id_matched"),
        F.count_if(F.col("s_by") == "label").alias("subject_label_matched"),
        F.count_if(has & (F.col("t_by") == "id")).alias("target_id_matched"),
        F.count_if(has & (F.col("t_by") == "label")).alias("target_label_matched"),
        F.count_if(has & F.col("t_by").isNull()).alias("external_targets"),
        F.count_if(~has).alias("unmatched_subjects"),
    )


def resolved_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN-12: relations whose target is a node."""
    n = nodes.select("image_id", F.col("id").alias("target_id"), F.col("obj_idx").alias("target_idx"))
    return relations.join(n.hint("merge"), ["image_id", "target_id"])


def fall_back(primary: DataFrame, grid: DataFrame) -> DataFrame:
    """PL-01: images without a primary row take all rows of the grid segmentor."""
    return primary.unionByName(grid.join(primary.select("image_id").distinct(), "image_id", "left_anti"))


def missing_triplets(counts: DataFrame, triplets: DataFrame, strict: bool = False) -> DataFrame:
    """PL-03: images with two objects or more and no triplet; strict fails the query."""
    bad = counts.where(F.col("n_objects") >= 2).join(triplets.select("image_id").distinct(), "image_id", "left_anti")
    if strict:
        return bad.withColumn("checked", F.raise_error(F.concat(F.lit("no triplets for image "), F.col("image_id").cast("string"))))
    return bad


def fan_out_modes(df: DataFrame, modes: list[str]) -> DataFrame:
    """PL-04: a copy of each row per known matching mode."""
    known = [m for m in modes if m in ("A", "B")]
    return df.select("*", F.explode(F.array(*map(F.lit, known))).alias("matching_mode")) if known else df.withColumn("matching_mode", F.lit("")).limit(0)


def calibration_gate(cal: DataFrame) -> DataFrame:
    """PL-05: verdict by usable frames and reprojection error."""
    v = F.when(F.col("usable_frames") == 0, "fail").when((F.col("usable_frames") < 10) | (F.col("rms") > 1), "warn").otherwise("ok")
    return cal.withColumn("verdict", v)
