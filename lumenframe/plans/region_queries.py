"""Queries over pixel tables and pairs of objects (RG, AG-01..11, JN-01..08, ST)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import geometry as G
from ..operators import pairs as P
from ..operators import regions as Q
from ..operators import relations as R
from ..sources import fixtures as X
from .geometry_queries import boxes
from .registry import query

OBJ = Q.OBJ


def masks(spark: SparkSession, d: str) -> DataFrame:
    return X.mask_words(spark, d).select(*Q.WORD, "bits")


def eroded(spark: SparkSession, d: str) -> DataFrame:
    return Q.erode(masks(spark, d), X.grid_size(spark, d))


def depth(spark: SparkSession, d: str, ring: bool = False) -> DataFrame:
    """The depth tiles that the masks touch, with their rings if wanted."""
    if not ring:
        return X.depth_tiles(spark, d, masked=True)
    # what the masks of an image grow over together is what each of them grows over
    union = Q.union_of_masks(masks(spark, d)).withColumn("obj_idx", F.lit(0).cast("long"))
    return X.depth_tiles(spark, d, Q.dilate(union, X.grid_size(spark, d)))


def clipped(spark: SparkSession, d: str) -> DataFrame:
    return Q.sigma_clip(Q.gather_depth(eroded(spark, d), depth(spark, d)))


def clipped_sized(spark: SparkSession, d: str) -> DataFrame:
    """The same with the areas of the masks that the pixels come from."""
    return Q.sigma_clip(Q.gather_depth(Q.with_area(eroded(spark, d)), depth(spark, d), [*OBJ, "num_pixels"]))


def clipped_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics need no pixels, only how many of a region have each depth."""
    counts = Q.depth_counts(Q.gather_depth(eroded(spark, d), depth(spark, d)))
    return Q.stats_of_counts(Q.clip_counts(counts))


def circle(spark: SparkSession, d: str) -> DataFrame:
    return Q.inner_circle(Q.with_distance(clipped_sized(spark, d)))


def all_objects(spark: SparkSession, d: str) -> DataFrame:
    return X.detections(spark, d).select(*OBJ)


def census(px: DataFrame) -> DataFrame:
    """A row per object that tells which pixels it has, without listing them."""
    return px.groupBy(*OBJ).agg(F.count(F.lit(1)).alias("n"), F.sum("px").alias("sx"), F.sum("py").alias("sy"), F.sum(F.col("px") * F.col("py")).alias("sxy"))


_CENSUS = "SELECT image_id, obj_idx, count(*) AS n, sum(px)::BIGINT AS sx, sum(py)::BIGINT AS sy, sum(px * py)::BIGINT AS sxy FROM {} GROUP BY ALL"


@query(_CENSUS.format("mask_px"))
def rg01_coordinates(spark, d):
    """Pixels to runs, and those to words and pixels."""
    runs = Q.pixels_to_run_lengths(X.mask_px(spark, d), OBJ)
    return census(Q.words_to_pixels(Q.run_lengths_to_words(runs)))


@query("SELECT image_id, obj_idx, k0 AS k FROM kernel")
def rg02_erosion_size(spark, d):
    return Q.extents(masks(spark, d)).select(*OBJ, Q.erosion_size().alias("k"))


@query(_CENSUS.format("eroded"))
def rg03_erode(spark, d):
    return census(Q.words_to_pixels(eroded(spark, d)))


@query(_CENSUS.format("dilated"))
def rg04_dilate(spark, d):
    return census(Q.words_to_pixels(Q.dilate(eroded(spark, d), X.grid_size(spark, d))))


@query(_CENSUS.format("ring"))
def rg05_ring(spark, d):
    """Also ST-03."""
    return census(Q.words_to_pixels(Q.border_ring(eroded(spark, d), X.grid_size(spark, d))))


@query("SELECT image_id, count(*) AS n, sum(px)::BIGINT AS sx, sum(py)::BIGINT AS sy FROM (SELECT DISTINCT image_id, px, py FROM mask_px) GROUP BY ALL")
def rg06_union(spark, d):
    """Also ST-04."""
    u = Q.union_of_masks(masks(spark, d)).withColumn("obj_idx", F.lit(0))
    return Q.words_to_pixels(u).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("px").alias("sx"), F.sum("py").alias("sy"))


@query("""SELECT p.image_id, p.a, p.b, greatest(0, least(m.x_min, n.x_min) - 10) AS x1, greatest(0, least(m.y_min, n.y_min) - 10) AS y1,
    least(gw, greatest(m.x_max, n.x_max) + 10) AS x2, least(gh, greatest(m.y_max, n.y_max) + 10) AS y2 FROM mask_pairs p JOIN sized USING (image_id)
    JOIN mask_area m ON m.image_id = p.image_id AND m.obj_idx = p.a JOIN mask_area n ON n.image_id = p.image_id AND n.obj_idx = p.b""")
def rg07_union_window(spark, d):
    w = masks(spark, d)
    return Q.union_window(P.mask_iou_pairs(w).select("image_id", "a", "b"), Q.extents(w), X.grid_size(spark, d))


@query("SELECT image_id, obj_idx, area, x_min, x_max, y_min, y_max FROM mask_area")
def ag01_extents(spark, d):
    return Q.extents(masks(spark, d))


@query("SELECT image_id, obj_idx, count(*) AS n, count(depth_mm) AS finite, sum(depth_mm)::BIGINT AS total FROM mask_px JOIN depth_px USING (image_id, px, py) GROUP BY ALL")
def jn01_gather(spark, d):
    g = Q.gather_depth(masks(spark, d), depth(spark, d))
    return g.groupBy(*OBJ).agg(F.count(F.lit(1)).alias("n"), F.count("depth_mm").alias("finite"), F.sum("depth_mm").alias("total"))


_STATS = """SELECT image_id, obj_idx, floor((lo) * 10 + 0.500001::DOUBLE) / 10000 AS d_min, floor((hi) * 10 + 0.500001::DOUBLE) / 10000 AS d_max, floor((s / n::DOUBLE) * 10 + 0.500001::DOUBLE) / 10000 AS d_mean,
    floor((med) * 10 + 0.500001::DOUBLE) / 10000 AS d_median, floor((sqrt((n * q - s * s)::DOUBLE) / n) * 10 + 0.500001::DOUBLE) / 10000 AS d_std, n AS n_clipped FROM stats"""


@query(_STATS)
def ag02_depth_stats(spark, d):
    return clipped_stats(spark, d).drop("mean_mm")


@query("SELECT image_id, obj_idx, count(*) AS n, sum(depth_mm)::BIGINT AS total FROM clipped GROUP BY ALL")
def ag03_sigma_clip(spark, d):
    return Q.by_hash(clipped(spark, d)).groupBy(*OBJ).agg(F.count(F.lit(1)).alias("n"), F.sum("depth_mm").alias("total"))


@query("SELECT DISTINCT image_id, obj_idx, wx, wy FROM near")
def ag04_weighted_centroid(spark, d):
    return Q.weighted_centroid(clipped(spark, d))


@query("SELECT image_id, obj_idx, u, v FROM snapped")
def ag05_snap(spark, d):
    return Q.snap_centroid(Q.with_distance(clipped(spark, d)))


@query("SELECT image_id, obj_idx, count(*) AS n, sum(depth_mm)::BIGINT AS total FROM circle GROUP BY ALL")
def ag06_inner_circle(spark, d):
    return Q.by_hash(circle(spark, d)).groupBy(*OBJ).agg(F.count(F.lit(1)).alias("n"), F.sum("depth_mm").alias("total"))


@query("SELECT image_id, obj_idx, z_pixels, round(z_mm, 4) AS z_mm FROM mode")
def ag07_histogram_mode(spark, d):
    m = Q.histogram_mode(circle(spark, d))
    return m.select(*OBJ, "z_pixels", F.round("z_mm", 4).alias("z_mm"))


@query("SELECT image_id, obj_idx, separation, transparent FROM region WHERE num_pixels > 0")
def ag08_separation(spark, d):
    ring = Q.border_ring(eroded(spark, d), X.grid_size(spark, d))
    return Q.separation(clipped_stats(spark, d), Q.gather_depth(ring, depth(spark, d, True)))


def region(spark: SparkSession, d: str) -> DataFrame:
    return Q.region_stats(all_objects(spark, d), masks(spark, d), depth(spark, d, True), X.grid_size(spark, d))


@query("SELECT * FROM region")
def ag09_region_stats(spark, d):
    """AG-02..09 for every object, with the default row for those without depth."""
    return region(spark, d)


@query("""SELECT r.image_id, r.obj_idx, r.d_mean, r.d_std, r.num_pixels, w.d_mean AS raw_d_mean, w.d_std AS raw_d_std, w.num_pixels AS raw_num_pixels FROM region r JOIN (
    SELECT o.image_id, o.obj_idx, coalesce(floor((s / n::DOUBLE) * 10 + 0.500001::DOUBLE) / 10000, 0) AS d_mean, coalesce(floor((sqrt((n * q - s * s)::DOUBLE) / n) * 10 + 0.500001::DOUBLE) / 10000, 0) AS d_std,
    CASE WHEN n IS NOT NULL THEN area ELSE 0 END AS num_pixels FROM (SELECT DISTINCT image_id, obj_idx FROM region) o LEFT JOIN mask_area USING (image_id, obj_idx) LEFT JOIN (
      SELECT image_id, obj_idx, count(*) AS n, sum(depth_mm)::BIGINT AS s, sum(depth_mm * depth_mm)::BIGINT AS q FROM (
        SELECT *, count(*) FILTER (ok) OVER (PARTITION BY image_id, obj_idx) AS m FROM (
          SELECT p.image_id, p.obj_idx, d.depth_mm, NOT (c.n >= 10 AND sqrt((c.n * c.q - c.s * c.s)::DOUBLE) / c.n > 1e-3) OR abs(c.n * d.depth_mm - c.s) < 2 * sqrt((c.n * c.q - c.s * c.s)::DOUBLE) AS ok
          FROM mask_px p JOIN depth_px d USING (image_id, px, py) JOIN (SELECT image_id, obj_idx, count(depth_mm) AS n, sum(depth_mm)::BIGINT AS s, sum(depth_mm * depth_mm)::BIGINT AS q
            FROM mask_px JOIN depth_px USING (image_id, px, py) GROUP BY ALL) c USING (image_id, obj_idx) WHERE d.depth_mm IS NOT NULL)) WHERE ok OR m < 5 GROUP BY ALL) USING (image_id, obj_idx)) w
    USING (image_id, obj_idx)""")
def ag10_erosion_comparison(spark, d):
    only = ("d_mean", "d_std", "num_pixels")
    return Q.erosion_comparison(all_objects(spark, d), masks(spark, d), depth(spark, d), X.grid_size(spark, d), only=only)


@query("SELECT image_id, floor((min(depth_mm)) * 10 + 0.500001::DOUBLE) / 10000 AS d_min, floor((max(depth_mm)) * 10 + 0.500001::DOUBLE) / 10000 AS d_max, floor((sum(depth_mm) / count(depth_mm)::DOUBLE) * 10 + 0.500001::DOUBLE) / 10000 AS d_mean FROM depth_px GROUP BY ALL")
def ag11_grid_stats(spark, d):
    return Q.grid_stats(X.depth_tiles(spark, d))


@query("SELECT image_id, a, b, inter, round(iou, 6) AS iou FROM mask_pairs")
def jn02_mask_iou(spark, d):
    return P.mask_iou_pairs(masks(spark, d)).withColumn("iou", F.round("iou", 6))


@query("SELECT image_id, a, b, round(iou, 6) AS iou FROM box_pairs")
def jn03_box_iou(spark, d):
    return P.box_iou_pairs(boxes(spark, d)).withColumn("iou", F.round("iou", 6))


@query("SELECT * FROM dedup")
def jn04_dedup(spark, d):
    """Also ST-01: the bag union of primaries and survivors."""
    o = X.detections(spark, d).select(*OBJ, "segmentor")
    return P.dedup_masks(o, X.mask_words(spark, d)).select(*OBJ, "origin")


def indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = X.detections(spark, d)
    masks = t.where("part_id % 5 <> 0").select("image_id", F.col("obj_idx").alias("mask_index"), (F.col("w") * F.col("h")).alias("area"))
    dets = t.where("part_id % 7 <> 0").select(*OBJ, F.when(F.col("part_id") % 11 == 0, 9999).otherwise(F.col("obj_idx")).alias("mask_index"), F.concat(F.lit("label_"), (F.col("part_id") % 9).cast("string")).alias("label"))
    return masks, dets


_MASKS = "(SELECT image_id, obj_idx AS mask_index, w * h AS area FROM detections WHERE part_id % 5 <> 0)"
_DETS = "(SELECT image_id, obj_idx, CASE WHEN part_id % 11 = 0 THEN 9999 ELSE obj_idx END AS mask_index, 'label_' || (part_id % 9) AS label FROM detections WHERE part_id % 7 <> 0)"


@query(f"SELECT d.image_id, d.obj_idx, coalesce(m.mask_index, -1) AS sam2_mask_index, coalesce(m.area, 0) AS area FROM {_DETS} d LEFT JOIN {_MASKS} m USING (image_id, mask_index)")
def jn05_match_by_detection(spark, d):
    masks, dets = indexed(spark, d)
    return P.match_by_detection(dets, masks)


@query(f"SELECT m.image_id, m.mask_index, coalesce(d.label, 'unlabeled') AS label, CASE WHEN d.obj_idx IS NULL THEN 'obj_' || m.mask_index || '_mask' ELSE 'obj_' || d.obj_idx || '_GroundedSAM2' END AS id FROM {_MASKS} m LEFT JOIN {_DETS} d USING (image_id, mask_index)")
def jn06_match_by_mask(spark, d):
    masks, dets = indexed(spark, d)
    return P.match_by_mask(masks, dets)


@query("SELECT image_id, a, b, rank FROM knn")
def jn07_nearest(spark, d):
    """Also TK-02."""
    return P.nearest(boxes(spark, d)).select("image_id", "a", "b", "rank")


@query("SELECT image_id, a, b FROM mask_pairs WHERE iou >= 0.02")
def jn08_semantic_gate(spark, d):
    return P.semantic_gate(P.mask_iou_pairs(masks(spark, d)))


@query("""SELECT image_id, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, conf_a, conf_b FROM (SELECT image_id, count(*) AS n_a, sum(conf_pct) / count(*)::DOUBLE AS conf_a FROM detections WHERE segmentor = 'GroundedSAM2' GROUP BY ALL)
    FULL JOIN (SELECT image_id, count(*) AS n_b, sum(conf_pct) / count(*)::DOUBLE AS conf_b FROM detections WHERE segmentor = 'SAM3' GROUP BY ALL) USING (image_id)""")
def jn14_compare_tracks(spark, d):
    return P.compare_tracks(X.detections(spark, d))


@query("""SELECT image_id, max_label AS label FROM (SELECT image_id, last_word AS max_label, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, obj_idx) AS r FROM detections JOIN captions USING (part_id)) WHERE r = 1""")
def ag13_largest_box_label(spark, d):
    """Also TK-05: the label of the largest box, the first on ties."""
    t = X.detections(spark, d).join(X.captions(spark, d).select("part_id", "last_word"), "part_id")
    best = F.max_by(F.lower(F.trim("last_word")), F.struct(F.col("w") * F.col("h"), -F.col("obj_idx")))
    return t.groupBy("image_id").agg(best.alias("label"))


@query("""SELECT image_id, obj_idx, segmentor FROM detections WHERE segmentor = 'GroundedSAM2' UNION ALL SELECT image_id, obj_idx, segmentor FROM detections WHERE segmentor = 'SAM2_AMG'
    AND image_id NOT IN (SELECT image_id FROM detections WHERE segmentor = 'GroundedSAM2')""")
def pl01_fall_back(spark, d):
    t = X.detections(spark, d).select("image_id", "obj_idx", "segmentor")
    return R.fall_back(t.where("segmentor = 'GroundedSAM2'"), t.where("segmentor = 'SAM2_AMG'"))


@query("SELECT image_id, obj_idx, row_number() OVER (PARTITION BY image_id ORDER BY z_mm, obj_idx) - 1 AS position FROM detections")
def wn01_position(spark, d):
    from ..operators.frames import positional

    return positional(X.detections(spark, d).select("image_id", "obj_idx", "z_mm"), ["image_id"], ["z_mm", "obj_idx"], "position").drop("z_mm")


@query("""SELECT model, avg_per_image, n_images, n_total_detections, min_per_image, max_per_image FROM report""")
def ag16_per_image(spark, d):
    return E.per_image(X.runs(spark, d), run_images(spark, d))


def run_images(spark: SparkSession, d: str) -> DataFrame:
    """Every model was run on every image: models x images, the intended set."""
    r = X.runs(spark, d)
    return r.select("image_id").distinct().crossJoin(F.broadcast(r.select("model").distinct()))


@query("SELECT model, conf_mean, conf_median, conf_min, conf_max FROM report")
def ag17_confidences(spark, d):
    return E.confidences(X.runs(spark, d))


@query("SELECT model, n_unique_labels, array_to_string(top_labels, ',') AS top_labels FROM report")
def ag18_label_diversity(spark, d):
    """Also TK-04."""
    return E.label_diversity(X.runs(spark, d)).withColumn("top_labels", F.array_join("top_labels", ","))


@query("SELECT model, n_scene_objects, mask_matched, mask_unmatched, mask_match_rate, depth_std_mean, depth_std_median FROM report")
def ag19_match_quality(spark, d):
    return E.match_quality(X.runs(spark, d))


def report(spark: SparkSession, d: str) -> DataFrame:
    r = X.runs(spark, d)
    return E.model_report(r, run_images(spark, d), r)


@query("SELECT * REPLACE (array_to_string(top_labels, ',') AS top_labels) FROM report")
def ag20_model_report(spark, d):
    """Also IO-14."""
    return report(spark, d).withColumn("top_labels", F.array_join("top_labels", ","))


def _norm(c: str, invert: bool = False) -> str:
    n = f"coalesce(({c}::DOUBLE - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE, 0.0::DOUBLE)"
    return f"CASE WHEN max({c}) OVER () IS NULL OR max({c}) OVER () = min({c}) OVER () THEN 0.5::DOUBLE ELSE {'1 - ' if invert else ''}{n} END"


@query(f"""SELECT model, score, row_number() OVER (ORDER BY score DESC, model)::INT AS rank FROM (SELECT model, round(0.15::DOUBLE * {_norm('avg_per_image')} + 0.2::DOUBLE * {_norm('conf_mean')} + 0.2::DOUBLE * {_norm('n_unique_labels')}
    + 0.3::DOUBLE * {_norm('mask_match_rate')} + 0.15::DOUBLE * {_norm('depth_std_mean', True)}, 6) AS score FROM report)""")
def ag21_composite_score(spark, d):
    """Also WN-03."""
    return E.composite_score(report(spark, d)).select("model", "score", "rank")


@query("SELECT a.model AS m1, b.model AS m2, len(list_intersect(a.top_labels, b.top_labels))::BIGINT AS shared FROM report a CROSS JOIN report b")
def st05_label_overlap(spark, d):
    return E.label_overlap(E.label_diversity(X.runs(spark, d)))


@query("""SELECT m.model, r.det_id, r.mask_matched FROM (SELECT *, ['GRiT', 'FasterRCNN', 'DETR', 'Pix2Seq', 'OWL-ViT', 'other'][(det_id % 6 + 1)::INT] AS source FROM runs) r
    JOIN (VALUES ('grit', 'GRiT'), ('faster_rcnn', 'FasterRCNN'), ('detr', 'DETR'), ('pix2seq', 'Pix2Seq'), ('pix2seq', 'OWL-ViT')) AS m(model, source) USING (source)""")
def jn13_by_source(spark, d):
    names = F.array(*map(F.lit, ("GRiT", "FasterRCNN", "DETR", "Pix2Seq", "OWL-ViT", "other")))
    t = X.runs(spark, d).select(F.element_at(names, (F.col("det_id") % 6 + 1).cast("int")).alias("source"), "det_id", "mask_matched")
    return E.by_source(t).drop("source")


def covered() -> Column:
    """The share of the smaller box that the other one covers: a caller's pair function."""
    side = lambda k: (F.col(f"{k}_x2") - F.col(f"{k}_x1")) * (F.col(f"{k}_y2") - F.col(f"{k}_y1"))
    w, h = F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1"), F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1")
    return F.when((w > 0) & (h > 0), w * h / F.least(side("a"), side("b"))).otherwise(0.0)


_COVERED = """CASE WHEN least(ax2, bx2) > greatest(ax1, bx1) AND least(ay2, by2) > greatest(ay1, by1) THEN (least(ax2, bx2) - greatest(ax1, bx1)) * (least(ay2, by2) - greatest(ay1, by1)) /
    least((ax2 - ax1) * (ay2 - ay1), (bx2 - bx1) * (by2 - by1))::DOUBLE ELSE 0 END"""


@query(f"""SELECT image_id, a AS sub_idx, b AS obj_idx, rank, CASE WHEN iou >= 0.1 THEN 'overlapping' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx > 0 THEN 'left_of' ELSE 'right_of' END
    WHEN dy > 0 THEN 'above' ELSE 'below' END AS predicate, CASE WHEN iou >= 0.1 THEN 0.85 ELSE 0.7 END::DOUBLE AS score FROM (SELECT *, {_COVERED} AS iou FROM knn)""")
def ud01_pair_iou(spark, d):
    """Box relations with a pair function of the caller's own in place of IoU."""
    return R.box_scaffold(boxes(spark, d), iou=covered)


@query("SELECT image_id, count(*) AS n, count(*) FILTER (segmentor = 'SAM3') AS sam3 FROM detections GROUP BY ALL")
def st01_bag_union(spark, d):
    t = X.detections(spark, d)
    parts = [t.where(F.col("segmentor") == s).select("image_id", "segmentor") for s in ("GroundedSAM2", "SAM2_AMG", "SAM3")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("segmentor") == "SAM3").alias("sam3"))
