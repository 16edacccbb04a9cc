"""Sources and sinks (IO)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp", "heic", "heif")

#: The records of documents.
DETECTION = "label string, conf double, bbox array<double>"
TRIPLET = "sub string, pred string, obj string, score double, sub_id string, obj_id string"
STATS = "struct<min:double,max:double,mean:double,median:double,std:double,num_pixels:bigint,z_val:double,z_val_pixels:bigint,possibly_transparent:boolean,depth_separation_from_background:double>"
XYZ = "struct<x:double,y:double,z:double>"
RELATION = "struct<predicate:string,target_id:string,target_label:string,target_caption:string,score:double>"
SOURCE = f"struct<label:string,caption:string,confidence:double,tags:array<string>,relations:array<{RELATION}>>"
OBJECT = (
    "struct<id:string,label:string,confidence:double,conf:double,bbox:array<int>,segmentor:string,"
    f"coordinates_3d:{XYZ},depth_stats:{STATS},mask_centroid_2d:array<int>,"
    f"coordinates_3d_no_erosion:{XYZ},depth_stats_no_erosion:{STATS},mask_centroid_2d_no_erosion:array<int>,"
    f"sam2_mask_index:int,sam3_mask_index:int,mask_matched:boolean,mask_path:string,depth_map_path:string,sources:map<string,{SOURCE}>>"
)
METADATA = (
    "struct<timestamp:string,segmentor:string,intrinsics:struct<fx:double,fy:double,cx:double,cy:double>,models:array<string>,rampp_tags:array<string>,gdino_query_used:string,"
    "relation_debug:struct<raw_triplets:bigint,num_detected_objects:bigint,num_mask_matched:bigint>,num_objects:bigint>"
)
SCENE = f"metadata {METADATA}, objects array<{OBJECT}>"
#: Nulls are written: a document tells that a value is missing.
JSON = {"ignoreNullFields": "false"}


def _typed(fields: str) -> str:
    return ",".join(x.strip().replace(" ", ":") for x in fields.split(","))


def scan_images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, fail_if_none: bool = True) -> DataFrame:
    """IO-01: plain files of a folder with one of the suffixes, in any case.

    Only names and lengths are read, never contents."""
    found = image_files(spark.read.format("binaryFile").load(folder).select("path", "length"), suffixes)
    if fail_if_none and found.isEmpty():
        raise ValueError(f"no images in {folder}")
    return found


def image_files(files: DataFrame, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """The same from a listing (path, length), such as a manifest table."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), ext.alias("ext"), "length").where(F.col("ext").isin(*suffixes))


def write_grids(depth: DataFrame, path: str, buckets: int = 16) -> None:
    """IO-03: depth tiles by image, at rest in a bounded number of folders."""
    b = F.pmod(F.xxhash64("image_id"), F.lit(buckets))
    depth.withColumn("bucket", b).repartition("bucket").sortWithinPartitions("image_id", "py", "tx").write.mode("overwrite").partitionBy("bucket").parquet(path)


def images_without_grid(frames: DataFrame, grids: DataFrame) -> DataFrame:
    """IO-03: what a later run still has to compute."""
    return frames.join(grids.select("image_id").distinct(), "image_id", "left_anti")


def read_detector_runs(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """IO-04, IO-15: (detections, rejected) of files {model}/{stem}_{model}.json, each an
    array of detections; a file that is no such array is rejected as a whole."""
    return detector_rows(spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def detector_rows(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from whole files as rows (path, value)."""
    parts = text.withColumns({"model": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "name": F.regexp_extract("path", r"([^/]+)$", 1)})
    parts = parts.withColumn("image_stem", F.expr("substr(name, 1, length(name) - length(model) - 6)"))
    read = parts.withColumn("dets", F.from_json("value", f"array<struct<{_typed(DETECTION)}>>"))
    bad = F.col("dets").isNull() | (F.size("dets") == 0) & ~F.col("value").rlike(r"^\s*\[\s*\]\s*$") | F.exists("dets", lambda d: d["label"].isNull())
    good = read.where(~bad).select("model", "image_stem", F.posexplode("dets").alias("det_no", "d")).select("model", "image_stem", "det_no", "d.*")
    return good, read.where(bad).select("path", "model", "image_stem")


def read_scenes(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """IO-05, SC-14: (objects, rejected) of scene documents.  An object belongs to the
    first key of its sources; from_json keeps the order of a document's keys."""
    return scene_rows(spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def scene_rows(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from whole files as rows (path, value)."""
    read = text.withColumn("doc", F.from_json("value", f"struct<metadata:{METADATA},objects:array<{OBJECT}>>"))
    bad = F.col("doc").isNull() | F.col("doc.objects").isNull()
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    rows = read.where(~bad).select(stem.alias("image_stem"), F.col("doc.metadata").alias("metadata"), F.posexplode("doc.objects").alias("obj_idx", "o"))
    objects = rows.select("image_stem", "obj_idx", F.get(F.map_keys("o.sources"), F.lit(0)).alias("source"), "o.*")
    return objects, read.where(bad).select("path")


def parse_triplets(payload: DataFrame, text: str = "value") -> DataFrame:
    """IO-06: a list, or an object with `triplets`; rows with an empty part are dropped,
    parts are trimmed and lower-cased, a missing score is 1."""
    item = f"struct<{_typed(TRIPLET)}>"
    rows = F.coalesce(F.from_json(text, f"struct<triplets:array<{item}>>")["triplets"], F.from_json(text, f"array<{item}>"))
    out = payload.select(*[c for c in payload.columns if c != text], F.posexplode(rows).alias("seq", "t")).where("t is not null")
    clean = {c: F.lower(F.trim(F.col(f"t.{c}"))) for c in ("sub", "pred", "obj")}
    out = out.withColumns(clean).where("sub <> '' and pred <> '' and obj <> ''")
    return out.withColumns({"score": F.coalesce("t.score", F.lit(1.0)), "sub_id": F.col("t.sub_id"), "obj_id": F.col("t.obj_id")}).drop("t")


def calibrations(cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IO-07: (usable, rejected); all of fx, fy, cx, cy are needed, distortion defaults to 0."""
    full = F.col("fx").isNotNull() & F.col("fy").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull()
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in cameras.columns else F.lit(0.0) for c in ("k1", "k2", "p1", "p2")}
    return cameras.where(full).withColumns(zero), cameras.where(~full)


def scene_documents(nodes: DataFrame, relations: DataFrame, metadata: DataFrame, second: bool = False) -> DataFrame:
    """IO-09, IO-12: one document per image, with every field of its objects.

    nodes(image_id, obj_idx, id, label, label_conf, bbox, segmentor, coordinates_3d,
    depth_stats, mask_centroid_2d, the last three also with _no_erosion (null: not
    compared), mask_index, mask_matched, mask_path, depth_map_path, and what each labeller
    says: caption, grounded_label, grounded_conf, florence2_label, florence2_caption,
    rampp_label, rampp_caption, rampp_tags), relations(image_id, source_id, seq,
    predicate, target_id, target_label, target_caption, score), metadata(image_id,
    metadata).  The second track names its segmentor and no other labeller.  Pixels are
    not part of a document."""
    rel = relations.groupBy("image_id", F.col("source_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "predicate", "target_id", "target_label", "target_caption", "score"))).alias("rel")
    )
    rel = rel.select("image_id", "id", F.transform("rel", lambda r: r.dropFields("seq")).alias("relations"))
    n = nodes.join(rel, ["image_id", "id"], "left").withColumn("relations", F.coalesce("relations", F.array().cast(f"array<{RELATION}>")))
    own = F.struct("caption", F.col("grounded_label").alias("label"), F.col("grounded_conf").alias("confidence"))
    florence = F.struct(F.col("florence2_label").alias("label"), F.col("florence2_caption").alias("caption"))
    tagger = F.struct(F.col("rampp_label").alias("label"), F.col("rampp_caption").alias("caption"), F.col("rampp_tags").alias("tags"))
    said = [own.alias("SAM3")] if second else [own.alias("GroundedSAM2"), florence.alias("Florence2"), tagger.alias("RAM++")]
    measured = [f"{c}{v}" for v in ("", "_no_erosion") for c in ("coordinates_3d", "depth_stats", "mask_centroid_2d")]
    one = F.struct(
        "id", "label", F.col("label_conf").alias("confidence"), F.col("label_conf").alias("conf"), "bbox", "segmentor", *measured,
        F.col("mask_index").alias("sam3_mask_index" if second else "sam2_mask_index"), "mask_matched", "mask_path", "depth_map_path",
        F.struct(*said, F.struct("relations").alias("Pix2SG")).alias("sources"),
    )
    docs = n.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("obj_idx", F.to_json(one, JSON).alias("json")))).alias("o"))
    body = F.concat(F.lit("["), F.array_join(F.transform("o", lambda x: x["json"]), ","), F.lit("]"))
    head = F.to_json("metadata", JSON)
    return docs.join(metadata, "image_id").select(
        "image_id", F.size("o").cast("long").alias("num_objects"), F.concat(F.lit('{"metadata":'), head, F.lit(',"objects":'), body, F.lit("}")).alias("document")
    )


def write_documents(docs: DataFrame, path: str, buckets: int = 16) -> None:
    """Documents as compressed JSON lines, in a bounded number of folders."""
    docs.withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").json(path, compression="gzip")


def depth_mask_documents(objects: DataFrame, images: DataFrame) -> DataFrame:
    """IO-10: one document per image and matching mode.  objects(image_id, matching_mode,
    mask_index, id, label, bbox, source_model, segmentor, depth_stats, coordinates_3d,
    mask_centroid_2d, and those with _no_erosion), images(image_id, image_path, stem,
    timestamp, width, height, depth_min, depth_max, depth_mean, num_auto_masks)."""
    measured = [F.col(f"{c}{v}").alias("coordinates_3d_from_mask" if (c, v) == ("coordinates_3d", "") else f"{c}{v}") for v in ("", "_no_erosion") for c in ("depth_stats", "coordinates_3d", "mask_centroid_2d")]
    none = F.lit(None).cast("string")
    one = F.struct("id", "label", "bbox", "source_model", "segmentor", F.col("mask_index").alias("sam2_mask_index"), none.alias("mask_path"), none.alias("masked_depth_path"), *measured)
    docs = objects.groupBy("image_id", "matching_mode").agg(F.array_sort(F.collect_list(F.struct("mask_index", one.alias("o")))).alias("found"))
    path = lambda end, *more: F.concat(F.lit("scene_graph/"), F.col("stem"), F.lit(end), *more)
    blocks = F.struct(
        F.struct("image_path", F.col("stem").alias("image_stem"), "timestamp", F.array("width", "height").alias("image_size"), "matching_mode").alias("metadata"),
        F.struct(path("_depth.npy").alias("depth_map_path"), path("_depth_map.png").alias("depth_map_image_path"), "depth_min", "depth_max", "depth_mean").alias("depth"),
        F.struct(
            F.lit("SAM2").alias("model"), F.lit("automatic_mask_generator").alias("mode"), path("_sam2_segmentation.png").alias("segmentation_map_image_path"),
            "num_auto_masks", F.lit("iou_with_detection_bbox").alias("match_strategy"),
        ).alias("segmentation"),
        F.struct(path("_depth_mask_mapping_", F.col("matching_mode"), F.lit(".png")).alias("mapping_image_path"), F.transform("found", lambda x: x["o"]).alias("objects")).alias("depth_mask"),
    )
    return docs.join(images, "image_id").select("image_id", "matching_mode", F.to_json(blocks, JSON).alias("document"))


def track_mask_documents(masks: DataFrame, images: DataFrame) -> DataFrame:
    """IO-11: one document per image of the second track.  masks(image_id, mask_index, x,
    y, w, h, area, predicted_iou, stability_score, label, score), images(image_id,
    image_path, stem, timestamp, width, height)."""
    box = F.array(*[F.col(c).cast("double") for c in "xywh"]).alias("bbox_xywh")
    one = F.struct("mask_index", F.lit(None).cast("string").alias("mask_path"), box, "area", "predicted_iou", "stability_score", "label", F.col("score").alias("sam3_score"))
    docs = masks.groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("masks")).join(images, "image_id")
    head = F.struct("image_path", F.col("stem").alias("image_stem"), "timestamp", F.array("width", "height").alias("image_size"), F.lit("SAM3").alias("model"), F.lit("text_prompted").alias("mode"))
    shown = F.concat(F.lit("sam3/"), F.col("stem"), F.lit("_sam3_segmentation.png")).alias("segmentation_map_image_path")
    summary = F.struct(F.size("masks").alias("num_masks"), shown, F.lit("sam3/masks").alias("masks_dir"))
    return docs.select("image_id", F.to_json(F.struct(head.alias("metadata"), summary.alias("summary"), "masks"), JSON).alias("document"))


def split_rejected(read: DataFrame, corrupt: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """IO-15: rows that parsed, and those that did not."""
    return read.where(F.col(corrupt).isNull()).drop(corrupt), read.where(F.col(corrupt).isNotNull()).select(corrupt)
