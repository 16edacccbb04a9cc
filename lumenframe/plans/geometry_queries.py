"""Queries over boxes, cameras, grids and labels (PF, SC, PL-04/05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import labels as L
from ..operators import geometry as G
from ..operators import pairs as P
from ..operators import relations as R
from ..operators.regions import box_words, tile_sum
from ..sources import fixtures as X
from ..sources import io as IO
from .registry import query
from .sql import GENERIC, noun, relation_case


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return G.centroid(G.to_corners(X.detections(spark, d)))


@query("""SELECT image_id, round(scale, 6) AS scale, round_even(width * scale, 0)::BIGINT AS out_w, round_even(height * scale, 0)::BIGINT AS out_h FROM (
    SELECT *, CASE WHEN greatest(width, height) > 1280 THEN 1280 / greatest(width, height)::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM frames)""")
def pf01_bound_side(spark, d):
    return G.bound_side(X.frames(spark, d)).select("image_id", F.round("scale", 6).alias("scale"), "out_w", "out_h")


@query("""SELECT image_id, count(*) AS n, count(depth_mm) AS finite, sum(depth_mm)::BIGINT AS total, sum(depth_mm * (s.px + 3 * s.py))::BIGINT AS placed FROM (
    SELECT image_id, gw, gh, px, unnest(range(gh // 3)) AS py FROM (SELECT *, unnest(range(gw // 2)) AS px FROM sized)) s
    JOIN depth_px p USING (image_id) WHERE p.px = s.px * gw // (gw // 2) AND p.py = s.py * gh // (gh // 3) GROUP BY ALL""")
def pf02_resample(spark, d):
    r = G.resample_grid(X.depth_tiles(spark, d), X.grid_size(spark, d), F.expr("gw div 2"), F.expr("gh div 3"))
    placed = F.col("depth_mm") * (F.col("px") + 3 * F.col("py"))
    return r.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count("depth_mm").alias("finite"), F.sum("depth_mm").alias("total"), F.sum(placed).alias("placed"))


@query("""SELECT image_id, obj_idx, greatest(0, x1 - 20) AS x1, greatest(0, y1 - 20) AS y1, least(width, x2 * 12) AS x2, least(height, y2 * 12) AS y2 FROM boxes JOIN frames USING (image_id)""")
def pf03_clamp(spark, d):
    b = boxes(spark, d).withColumns({"x1": F.col("x1") - 20, "y1": F.col("y1") - 20, "x2": F.col("x2") * 12, "y2": F.col("y2") * 12})
    b = b.join(X.frames(spark, d).select("image_id", "width", "height"), "image_id")
    return G.clamp_box(b, F.col("width"), F.col("height")).select("image_id", "obj_idx", "x1", "y1", "x2", "y2")


@query("SELECT image_id, obj_idx, x1, y1, x2, y2, x2 - x1 AS w, y2 - y1 AS h FROM boxes")
def pf04_corners(spark, d):
    return G.to_extent(G.to_corners(X.detections(spark, d))).select("image_id", "obj_idx", "x1", "y1", "x2", "y2", "w", "h")


@query("""SELECT image_id, obj_idx, round(x1 / scale, 4) AS x1, round(y1 / scale, 4) AS y1, round(x2 / scale, 4) AS x2, round(y2 / scale, 4) AS y2 FROM boxes JOIN (
    SELECT image_id, CASE WHEN greatest(width, height) > 1280 THEN 1280 / greatest(width, height)::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM frames) USING (image_id)""")
def pf05_undo_scale(spark, d):
    b = boxes(spark, d).join(G.bound_side(X.frames(spark, d)).select("image_id", "scale"), "image_id")
    c = ["x1", "y1", "x2", "y2"]
    return G.undo_scale(b, c, F.col("scale")).select("image_id", "obj_idx", *[F.round(k, 4).alias(k) for k in c])


@query("SELECT image_id, obj_idx, coalesce(m.area, d.w * d.h) AS area FROM detections d LEFT JOIN mask_area m USING (image_id, obj_idx)")
def pf06_area(spark, d):
    from ..operators.regions import extents

    m = extents(X.mask_words(spark, d)).select("image_id", "obj_idx", F.col("area").alias("pixels"))
    j = X.detections(spark, d).join(m, ["image_id", "obj_idx"], "left")
    return j.select("image_id", "obj_idx", G.area_or_box(F.col("pixels"), F.col("w"), F.col("h")).alias("area"))


@query("""SELECT b.image_id, b.obj_idx, coalesce(round(mx, 6), ux) AS ux, coalesce(round(my, 6), uy) AS uy FROM boxes b LEFT JOIN (
    SELECT image_id, obj_idx, sum(px) / count(*)::DOUBLE AS mx, sum(py) / count(*)::DOUBLE AS my FROM mask_px GROUP BY ALL) USING (image_id, obj_idx)""")
def pf07_centroid(spark, d):
    n = F.count(F.lit(1))
    m = X.mask_px(spark, d).groupBy("image_id", "obj_idx").agg(F.round(F.sum("px") / n, 6).alias("mx"), F.round(F.sum("py") / n, 6).alias("my"))
    b = G.to_corners(X.detections(spark, d)).join(m, ["image_id", "obj_idx"], "left")
    return G.centroid(b, "mx", "my").select("image_id", "obj_idx", "ux", "uy")


@query("""SELECT image_id, obj_idx, round_even(x1 / 4.0::DOUBLE, 0)::INT AS x1, round_even(y1 / 4.0::DOUBLE, 0)::INT AS y1, round_even(x2 / 4.0::DOUBLE, 0)::INT AS x2, round_even(y2 / 4.0::DOUBLE, 0)::INT AS y2 FROM boxes""")
def pf08_integer_box(spark, d):
    b = boxes(spark, d).withColumns({c: F.col(c) / 4.0 for c in ("x1", "y1", "x2", "y2")})
    return G.integer_box(b).select("image_id", "obj_idx", "x1", "y1", "x2", "y2")


def camera_of(spark: SparkSession, d: str) -> DataFrame:
    """Images stay dealt as they are, and many of a camera do not meet in one task: the
    cameras that took them, which are few, go to the images."""
    frames = X.frames(spark, d)
    used = X.cameras(spark, d).join(frames.select("camera_id").distinct(), "camera_id", "left_semi")
    return G.intrinsics(frames, F.broadcast(used))


@query("SELECT image_id, k_source, round(fx, 4) AS fx, round(fy, 4) AS fy, cx, cy FROM k")
def pf09_intrinsics(spark, d):
    return camera_of(spark, d).select("image_id", "k_source", F.round("fx", 4).alias("fx"), F.round("fy", 4).alias("fy"), "cx", "cy")


@query("""SELECT image_id, px, py, round((nx * rad + 2 * 0.001::DOUBLE * nx * ny + 0.002::DOUBLE * (r2 + 2 * nx * nx)) * fx + cx, 4) AS src_x,
    round((ny * rad + 0.001::DOUBLE * (r2 + 2 * ny * ny) + 2 * 0.002::DOUBLE * nx * ny) * fy + cy, 4) AS src_y FROM (
    SELECT *, 1 + k1 * r2 + k2 * r2 * r2 AS rad FROM (SELECT *, nx * nx + ny * ny AS r2 FROM (
    SELECT *, (px - cx) / fx AS nx, (py - cy) / fy AS ny FROM (SELECT image_id, image_id % width AS px, image_id % height AS py, fx, fy, cx, cy, coalesce(k1, 0) AS k1, coalesce(k2, 0) AS k2 FROM k))))""")
def pf10_distort(spark, d):
    f = camera_of(spark, d).join(X.frames(spark, d).select("image_id", "camera_id"), "image_id")
    f = f.join(X.cameras(spark, d).select("camera_id", "k1", "k2"), "camera_id", "left")
    f = f.withColumns({"px": F.col("image_id") % F.col("width"), "py": F.col("image_id") % F.col("height"), "p1": F.lit(0.001), "p2": F.lit(0.002)})
    f = f.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("k1", "k2")})
    return G.distort(f).select("image_id", "px", "py", F.round("src_x", 4).alias("src_x"), F.round("src_y", 4).alias("src_y"))


@query("""SELECT image_id, obj_idx, round_even((ux - cx) * (z_mm / 1000.0::DOUBLE) / fx, 3) AS x_m, round_even((uy - cy) * (z_mm / 1000.0::DOUBLE) / fy, 3) AS y_m,
    round_even(z_mm / 1000.0::DOUBLE, 3) AS z_m FROM boxes JOIN k USING (image_id)""")
def pf11_back_project(spark, d):
    b = boxes(spark, d).join(camera_of(spark, d), "image_id")
    xyz = G.back_project(F.col("ux"), F.col("uy"), F.col("z_mm") / 1000.0)
    return b.select("image_id", "obj_idx", *[c.alias(n) for n, c in xyz.items()])


@query("SELECT image_id, obj_idx, segmentor, conf_pct FROM detections WHERE (conf_pct - 45) / 100.0::DOUBLE >= CASE WHEN segmentor = 'SAM3' THEN 0.3::DOUBLE ELSE 0.15::DOUBLE END")
def pf12_score_gate(spark, d):
    t = X.detections(spark, d)
    return G.score_gate(t, (F.col("conf_pct") - 45) / 100.0, F.col("segmentor")).select("image_id", "obj_idx", "segmentor", "conf_pct")


@query("""SELECT image_id, obj_idx FROM detections JOIN frames USING (image_id) WHERE conf_pct / 100.0::DOUBLE >= 0.6::DOUBLE AND part_id % 100 / 100.0::DOUBLE >= 0.1::DOUBLE
    AND w * h >= 30 AND w * h <= 0.0004::DOUBLE * (width * height)""")
def pf13_mask_quality(spark, d):
    t = X.detections(spark, d).join(X.frames(spark, d).select("image_id", "width", "height"), "image_id")
    t = t.withColumns({"stability": F.col("conf_pct") / 100.0, "predicted_iou": F.col("part_id") % 100 / 100.0, "area": F.col("w") * F.col("h"), "image_area": F.col("width") * F.col("height")})
    return G.mask_quality(t, 0.6, 0.1, 30, 0.0004).select("image_id", "obj_idx")


@query("SELECT image_id, obj_idx, w <= 4 * s OR h <= 4 * s AS degenerate FROM detections JOIN frames USING (image_id)")
def pf14_degenerate(spark, d):
    b = boxes(spark, d).join(X.frames(spark, d).select("image_id", "s"), "image_id")
    b = b.withColumns({"x2": F.col("x2") - 4 * F.col("s"), "y2": F.col("y2") - 4 * F.col("s")})
    return b.select("image_id", "obj_idx", G.is_degenerate().alias("degenerate"))


@query("SELECT image_id, obj_idx, round(z_mm / 1000.0::DOUBLE * 10.0::DOUBLE, 4) AS depth FROM detections")
def pf15_depth_scale(spark, d):
    return X.detections(spark, d).select("image_id", "obj_idx", F.round(G.scale_depth(F.col("z_mm") / 1000.0, 10.0), 4).alias("depth"))


def _norm_census(px: DataFrame, keys: list[str], value: str = "norm") -> DataFrame:
    """Number, sum and weighted sum of whole norms: which pixel has which tells in the last."""
    n = F.floor(value).cast("long")
    return px.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"), F.sum(n * (F.col("px") + 3 * F.col("py"))).alias("placed"))


_NORMS = "count(*) AS n, sum(norm)::BIGINT AS total, sum(norm * (px + 3 * py))::BIGINT AS placed"


@query(f"""SELECT image_id, {_NORMS} FROM (SELECT p.image_id, px, py, CASE WHEN hi = lo THEN 0 ELSE floor((depth_mm - lo) * 255.0::DOUBLE / (hi - lo)) END::BIGINT AS norm
    FROM depth_px p JOIN (SELECT image_id, min(depth_mm) AS lo, max(depth_mm) AS hi FROM depth_px GROUP BY ALL) USING (image_id) WHERE depth_mm IS NOT NULL) GROUP BY ALL""")
def pf16_normalise(spark, d):
    return _norm_census(G.normalise_grid(X.depth_tiles(spark, d)).where("depth_mm is not null"), ["image_id"])


@query(f"""SELECT image_id, {_NORMS} FROM (SELECT u.image_id, u.px, u.py, floor((depth_mm - lo) * 100.0::DOUBLE / CASE WHEN hi = lo THEN 1 ELSE hi - lo END)::BIGINT AS norm FROM (
    SELECT DISTINCT image_id, px, py FROM mask_px) u JOIN depth_px d USING (image_id, px, py) JOIN (SELECT image_id, min(depth_mm) AS lo, max(depth_mm) AS hi FROM depth_px
    SEMI JOIN mask_px USING (image_id, px, py) GROUP BY ALL) USING (image_id) WHERE depth_mm IS NOT NULL) GROUP BY ALL""")
def pf17_normalise_masked(spark, d):
    from ..operators.regions import union_of_masks

    union = union_of_masks(X.mask_words(spark, d))
    return _norm_census(G.normalise_under(union, X.depth_tiles(spark, d, masked=True), ["image_id"], 100.0, widen=1.0), ["image_id"])


@query("""SELECT image_id, obj_idx, count(*) AS n, sum(floor(CASE WHEN hi = lo THEN 0 ELSE (depth_mm - lo) * 1000.0::DOUBLE / (hi - lo) END))::BIGINT AS total FROM (
    SELECT b.image_id, b.obj_idx, p.depth_mm, min(depth_mm) OVER w AS lo, max(depth_mm) OVER w AS hi FROM box_px b JOIN depth_px p USING (image_id, px, py)
    WHERE depth_mm IS NOT NULL WINDOW w AS (PARTITION BY b.image_id, b.obj_idx)) GROUP BY ALL""")
def pf18_normalise_in_box(spark, d):
    b = boxes(spark, d).select("image_id", "obj_idx", "x1", "y1", "x2", "y2")
    p = G.normalise_under(box_words(b), X.depth_tiles(spark, d, boxed=True), ["image_id", "obj_idx"], 1000.0)
    return p.groupBy("image_id", "obj_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("norm")).cast("long").alias("total"))


@query(f"""SELECT image_id, {_NORMS} FROM (SELECT image_id, px, py, floor(least(greatest(depth_mm / 1000.0::DOUBLE / CASE WHEN image_id % 200 = 0 THEN 20.0::DOUBLE ELSE 80.0::DOUBLE END * 65535, 0), 65535))::BIGINT AS norm
    FROM depth_px WHERE depth_mm IS NOT NULL) GROUP BY ALL""")
def pf19_quantise(spark, d):
    q = G.quantise16(F.col("depth_mm") / 1000.0, F.col("image_id") % 200 == 0)
    return _norm_census(X.depth_px(spark, d).where("depth_mm is not null").withColumn("q16", q), ["image_id"], "q16")


@query("SELECT image_id, count(*) AS pixels, count(depth_mm) AS finite FROM depth_px GROUP BY ALL")
def pf20_finite(spark, d):
    finite = tile_sum(lambda mm: G.is_finite((mm / 1000.0).cast("float")).cast("int"))
    tiles = X.depth_tiles(spark, d).select("image_id", F.size("depth").alias("pixels"), finite.alias("finite"))
    return tiles.groupBy("image_id").agg(F.sum("pixels").alias("pixels"), F.sum("finite").alias("finite"))


@query("SELECT image_id, obj_idx, count(*) AS n, sum(depth_mm)::BIGINT AS total FROM box_px JOIN depth_px USING (image_id, px, py) GROUP BY ALL")
def pf21_crop(spark, d):
    b = boxes(spark, d).select("image_id", "obj_idx", "x1", "y1", "x2", "y2")
    return G.crop(X.depth_tiles(spark, d, boxed=True), b).groupBy("image_id", "obj_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("depth_mm").alias("total"))


_PARTS = f"""SELECT doc_id, p, min(i) AS i FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id,
    list_transform(string_split_regex(lower(trim(text)), '[|,;.]'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))) AS ps FROM documents)) WHERE p <> '' AND p NOT IN {GENERIC} GROUP BY ALL"""
_TOP = f"SELECT doc_id, list(p ORDER BY i) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM ({_PARTS})) WHERE r <= 8 GROUP BY doc_id"


@query(f"SELECT doc_id, coalesce(array_to_string(tags, '|'), '') AS tags, coalesce(len(tags), 0)::INT AS n FROM documents LEFT JOIN ({_TOP}) USING (doc_id)")
def sc01_tags(spark, d):
    t = X.read(spark, d, "documents").select("doc_id", L.parse_tags(F.col("text")).alias("tags"))
    return t.select("doc_id", F.array_join("tags", "|").alias("tags"), F.size("tags").alias("n"))


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN coalesce(source, '') WHEN 1 THEN coalesce(lang, '') WHEN 2 THEN '[' || chr(39) || 'x' || doc_id || chr(39) || ', ' || chr(39) || 'y' || chr(39) || ']' WHEN 3 THEN coalesce(lang || source, '') WHEN 4 THEN 'e' || doc_id
    WHEN 5 THEN '[brackets] ' || doc_id WHEN 6 THEN '[text' ELSE '' END AS tag_text FROM documents""")
def sc02_tag_field(spark, d):
    """Objects with each field, a list under a key, a list, texts that begin with a
    bracket, and nothing."""
    t = X.read(spark, d, "documents")
    k, none, n = F.col("doc_id") % 8, F.lit(None).cast("string"), F.col("doc_id").cast("string")
    fields = F.to_json(
        F.struct(
            F.when(k == 0, F.col("source")).when(k == 1, F.lit("")).when(k == 6, F.lit("[text")).otherwise(none).alias("tags"),
            F.when(k == 1, F.col("lang")).otherwise(none).alias("tag_en"),
            F.when(k == 2, F.array(F.concat(F.lit("x"), n), F.lit("y"))).alias("english"),
            F.when(k == 3, F.concat("lang", "source")).otherwise(none).alias("labels"),
        )
    )
    listed = F.to_json(F.array(F.concat(F.lit("e"), n), F.lit("y")))
    payload = F.when(k == 4, listed).when(k == 5, F.concat(F.lit('"[brackets] '), n, F.lit('"'))).otherwise(fields)
    return t.select("doc_id", L.tag_field(payload).alias("tag_text"))


@query(f"SELECT part_id, {noun('caption')} AS noun FROM captions")
def sc03_caption_noun(spark, d):
    return X.captions(spark, d).select("part_id", L.caption_noun(F.col("caption")).alias("noun"))


@query(f"SELECT part_id, {relation_case('caption')} AS pred, {relation_case('phrase')} AS of_phrase FROM captions")
def sc04_relation_phrase(spark, d):
    return X.captions(spark, d).select("part_id", L.relation_phrase(F.col("caption")).alias("pred"), L.relation_phrase(F.col("phrase")).alias("of_phrase"))


@query("SELECT part_id, CASE WHEN part_id % 7 = 0 THEN 'object' ELSE type_label END AS label FROM captions")
def sc05_clean_label(spark, d):
    raw = F.when(F.col("part_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.upper("type_label"), F.lit(" ")))
    return X.captions(spark, d).select("part_id", L.clean_label(raw).alias("label"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """The objects of all detections, with their labels and what each labeller says, and
    what an earlier run's triplets are made of."""
    c = X.label_candidates(spark, d)
    pick = L.choose_label(F.col("detector_label"), F.col("conf"), F.col("caption_label"), F.col("caption"), F.col("tag_label"), F.lit(0.7))
    c = c.select("image_id", "obj_idx", "segmentor", "x", "y", "w", "h", "z_mm", "part_id", "detector_label", F.col("conf").alias("grounded_conf"), pick.alias("p"), "last_word", "pred", "next_word")
    said = ("label", "caption", "source_model", "florence2_label", "florence2_caption", "rampp_label", "rampp_caption", "rampp_tags")
    return c.select(
        "image_id", "obj_idx", "segmentor", "x", "y", "w", "h", "z_mm", "part_id", L.object_id(F.col("obj_idx"), F.col("segmentor")).alias("id"),
        L.clean_label(F.col("detector_label")).alias("grounded_label"), "grounded_conf", F.col("p.conf").alias("label_conf"), *[F.col(f"p.{k}").alias(k) for k in said],
        "last_word", "pred", "next_word",
    )


@query("SELECT image_id, obj_idx, label, label_conf, caption, source_model FROM labelled")
def sc06_choose_label(spark, d):
    return labelled(spark, d).select("image_id", "obj_idx", "label", "label_conf", "caption", "source_model")


@query("""SELECT image_id, obj_idx, CASE part_id % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.8 WHEN 2 THEN CASE WHEN part_id % 8 = 2 THEN 0.7 ELSE conf_pct / 100.0 END ELSE 0 END::DOUBLE AS conf FROM detections""")
def sc07_candidate_confidence(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("caption", "box", "tag", "generic"))), (F.col("part_id") % 4 + 1).cast("int"))
    given = F.when(F.col("part_id") % 8 != 2, F.col("conf_pct") / 100.0)
    return X.detections(spark, d).select("image_id", "obj_idx", L.candidate_confidence(kind, given).alias("conf"))


@query(f"SELECT doc_id, coalesce(array_to_string(tags, '. ') || '.', 'object.') AS query FROM documents LEFT JOIN ({_TOP}) USING (doc_id)")
def sc08_query_text(spark, d):
    return X.read(spark, d, "documents").select("doc_id", L.query_text(L.parse_tags(F.col("text")), DEFAULT.default_query).alias("query"))


@query("""SELECT image_id, obj_idx, CASE segmentor WHEN 'SAM3' THEN 'sam3_obj_' || obj_idx ELSE 'obj_' || obj_idx || '_GroundedSAM2' END AS id, 'obj_' || obj_idx || '_GroundedSAM2' AS first_id, 'external_' || last_word AS external, last_word AS back
    FROM detections JOIN captions USING (part_id)""")
def sc12_ids(spark, d):
    t = X.detections(spark, d).join(X.captions(spark, d).select("part_id", "last_word"), "part_id")
    ext = L.external_id(F.concat(F.lit(" "), F.upper("last_word")))
    return t.select("image_id", "obj_idx", L.object_id(F.col("obj_idx"), F.col("segmentor")).alias("id"), L.object_id(F.col("obj_idx")).alias("first_id"), ext.alias("external"), L.external_label(ext).alias("back"))


@query("SELECT image_id, CASE WHEN n3 = 0 THEN 'n/a' ELSE printf('%.1f%%', 100.0::DOUBLE * n1 / n3) END AS pct FROM (SELECT image_id, count(*) FILTER (segmentor = 'SAM3') AS n3, count(*) FILTER (segmentor = 'SAM3' AND part_id % 3 = 0) AS n1 FROM detections GROUP BY ALL)")
def sc13_ratio_text(spark, d):
    three = F.col("segmentor") == "SAM3"
    n = X.detections(spark, d).groupBy("image_id").agg(F.count_if(three).alias("n3"), F.count_if(three & (F.col("part_id") % 3 == 0)).alias("n1"))
    return n.select("image_id", L.ratio_text(F.col("n1"), F.col("n3")).alias("pct"))


@query("""SELECT image_id, obj_idx, CASE WHEN part_id % 2 = 0 THEN 'GroundedSAM2' ELSE 'SAM3' END AS first_source, CASE WHEN part_id % 3 <> 0 THEN z_mm / 1000.0::DOUBLE END AS std FROM detections""")
def sc14_accessors(spark, d):
    """The first key of a sources map, and a nested field, after a round trip as JSON."""
    t, even = X.detections(spark, d), F.col("part_id") % 2 == 0
    one, two = F.when(even, "GroundedSAM2").otherwise("SAM3"), F.when(even, "Pix2SG").otherwise("Aux")
    doc = F.to_json(F.struct(F.create_map(one, F.struct(F.lit(1).alias("n")), two, F.struct(F.lit(2).alias("n"))).alias("sources"), F.struct(F.when(F.col("part_id") % 3 != 0, F.col("z_mm") / 1000.0).alias("std")).alias("depth_stats")))
    back = F.from_json(doc, "struct<sources:map<string,struct<n:int>>,depth_stats:struct<std:double>>")
    return t.select("image_id", "obj_idx", back.alias("b")).select("image_id", "obj_idx", F.get(F.map_keys("b.sources"), F.lit(0)).alias("first_source"), F.col("b.depth_stats.std").alias("std"))


@query("""SELECT image_id, obj_idx, round(sqrt((w * w + h * h)::DOUBLE), 6) AS diagonal, round(tan(radians(conf_pct::DOUBLE) / 2), 6) AS t, abs(x - y) AS off, least(greatest(x, 5), 20) AS clipped FROM detections""")
def sc15_math(spark, d):
    t = X.detections(spark, d)
    return t.select("image_id", "obj_idx", F.round(F.hypot("w", "h"), 6).alias("diagonal"), F.round(F.tan(F.radians(F.col("conf_pct")) / 2), 6).alias("t"), F.abs(F.col("x") - F.col("y")).alias("off"), F.least(F.greatest("x", F.lit(5)), F.lit(20)).alias("clipped"))


_NAMES = ("person", "Bicycle", "car", "DOG", "vase", "table")


def _named(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, _NAMES))
    return X.detections(spark, d).select("image_id", "obj_idx", F.element_at(names, (F.col("part_id") % 6 + 1).cast("int")).alias("name"))


@query("""SELECT c.id, c.name, count(t.image_id) AS detections, count(DISTINCT t.image_id) AS images FROM categories c LEFT JOIN (SELECT image_id, lower([
    'person', 'Bicycle', 'car', 'DOG', 'vase', 'table'][(part_id % 6 + 1)::INT]) AS name FROM detections) t ON t.name = c.name GROUP BY ALL""")
def io08_categories(spark, d):
    """The dimension, with what the tables hold of each category."""
    found = P.with_category(_named(spark, d), "name", X.categories(spark)).where("category_id is not null")
    n = found.groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("detections"), F.count_distinct("image_id").alias("images"))
    zero = F.lit(0).cast("long")
    return X.categories(spark).join(n, "id", "left").select("id", "name", F.coalesce("detections", zero).alias("detections"), F.coalesce("images", zero).alias("images"))


@query("""SELECT t.image_id, t.obj_idx, t.name, c.id AS category_id FROM (SELECT image_id, obj_idx, [
    'person', 'Bicycle', 'car', 'DOG', 'vase', 'table'][(part_id % 6 + 1)::INT] AS name FROM detections) t LEFT JOIN categories c ON lower(c.name) = lower(t.name)""")
def jn11_category(spark, d):
    return P.with_category(_named(spark, d), "name", X.categories(spark))


@query("SELECT camera_id, fx, fy, cx, cy, k1, k2, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2 FROM cameras WHERE fx IS NOT NULL AND fy IS NOT NULL AND cx IS NOT NULL AND cy IS NOT NULL")
def io07_calibrations(spark, d):
    return IO.calibrations(X.cameras(spark, d))[0]


@query("SELECT image_id, obj_idx, m AS matching_mode FROM detections, (SELECT unnest(['A', 'B']) AS m)")
def pl04_modes(spark, d):
    return R.fan_out_modes(X.detections(spark, d).select("image_id", "obj_idx"), ["A", "X", "B"])


@query("""SELECT camera_id, camera_id % 25 AS usable_frames, (camera_id % 20) / 10.0::DOUBLE AS rms, CASE WHEN camera_id % 25 = 0 THEN 'fail' WHEN camera_id % 25 < 10 OR (camera_id % 20) / 10.0::DOUBLE > 1 THEN 'warn' ELSE 'ok' END AS verdict FROM cameras""")
def pl05_calibration_gate(spark, d):
    c = X.cameras(spark, d).select("camera_id", (F.col("camera_id") % 25).alias("usable_frames"), (F.col("camera_id") % 20 / 10.0).alias("rms"))
    return R.calibration_gate(c)
