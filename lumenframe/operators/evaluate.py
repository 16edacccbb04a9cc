"""Detector evaluation: statistics per model, overlap of labels, ranking (AG-16..21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Detector names and the source strings of scene objects.
SOURCES = (("grit", "GRiT"), ("faster_rcnn", "FasterRCNN"), ("detr", "DETR"), ("pix2seq", "Pix2Seq"), ("pix2seq", "OWL-ViT"))
#: Metric, weight, whether less is better.
WEIGHTS = (
    ("avg_per_image", 0.15, False),
    ("conf_mean", 0.20, False),
    ("n_unique_labels", 0.20, False),
    ("mask_match_rate", 0.30, False),
    ("depth_std_mean", 0.15, True),
)


def per_image(runs: DataFrame, images: DataFrame) -> DataFrame:
    """AG-16: images(model, image_id) drives, so that images without detections count."""
    n = runs.groupBy("model", "image_id").agg(F.count(F.lit(1)).alias("n"))
    full = images.join(n, ["model", "image_id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return full.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_images"),
        F.sum("n").alias("n_total_detections"),
        F.bround(F.sum("n") / F.count(F.lit(1)), 1).alias("avg_per_image"),
        F.min("n").alias("min_per_image"),
        F.max("n").alias("max_per_image"),
    )


def confidences(runs: DataFrame) -> DataFrame:
    """AG-17: nulls do not count; null when there is none."""
    return runs.groupBy("model").agg(
        F.bround(F.avg("conf"), 4).alias("conf_mean"),
        F.bround(F.percentile("conf", F.lit(0.5)), 4).alias("conf_median"),
        F.bround(F.min("conf"), 4).alias("conf_min"),
        F.bround(F.max("conf"), 4).alias("conf_max"),
    )


def label_diversity(runs: DataFrame, top: int = 15) -> DataFrame:
    """AG-18, TK-04: number of labels, and the first of them by name."""
    lab = runs.select("model", F.lower(F.trim("label")).alias("label")).where("label <> ''").distinct()
    rank = F.row_number().over(Window.partitionBy("model").orderBy("label"))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.col("label"))))
    out = lab.withColumn("r", rank).groupBy("model").agg(F.count(F.lit(1)).alias("n_unique_labels"), first.alias("top_labels"))
    models = runs.select("model").distinct()
    none = F.array().cast("array<string>")
    return models.join(out, "model", "left").select(
        "model", F.coalesce("n_unique_labels", F.lit(0).cast("long")).alias("n_unique_labels"), F.coalesce("top_labels", none).alias("top_labels")
    )


def match_quality(objects: DataFrame) -> DataFrame:
    """AG-19: mask matches and depth cleanliness."""
    ok = F.coalesce("mask_matched", F.lit(False))
    return objects.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_scene_objects"),
        F.count_if(ok).alias("mask_matched"),
        F.count_if(~ok).alias("mask_unmatched"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("mask_match_rate"),
        F.bround(F.avg("depth_std"), 4).alias("depth_std_mean"),
        F.bround(F.percentile("depth_std", F.lit(0.5)), 4).alias("depth_std_median"),
    )


def model_report(runs: DataFrame, images: DataFrame, objects: DataFrame) -> DataFrame:
    """AG-20: one record per model that has images."""
    out = per_image(runs, images)
    for part in (confidences(runs), label_diversity(runs), match_quality(objects)):
        out = out.join(part, "model", "left")
    zero = F.lit(0).cast("long")
    counts = {c: F.coalesce(c, zero) for c in ("n_unique_labels", "n_scene_objects", "mask_matched", "mask_unmatched")}
    return out.withColumns(counts)


def min_max_score(value: Column, lower_is_better: bool = False) -> Column:
    """Of one metric across all models: 0.5 for all if they do not differ; null is the
    worst, or the best where less is better."""
    over = Window.partitionBy(F.lit(0))
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    norm = F.coalesce((value - lo) / (hi - lo), F.lit(0.0))
    norm = 1.0 - norm if lower_is_better else norm
    return F.when(hi.isNull() | (hi == lo), 0.5).otherwise(norm)


def composite_score(report: DataFrame) -> DataFrame:
    """AG-21, WN-03: score and rank of each model (a row per model: a tiny table)."""
    score = F.lit(0.0)
    for name, weight, lower in WEIGHTS:
        score = score + weight * min_max_score(F.col(name).cast("double"), lower)
    out = report.withColumn("score", F.round(score, 6))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "model")))


def label_overlap(report: DataFrame) -> DataFrame:
    """ST-05: shared top labels of every pair of models, itself included.

    Labels meet by an equi-join; pairs that share none come from the models."""
    lab = report.select("model", F.explode("top_labels").alias("label"))
    names = report.select("model")
    met = lab.select(F.col("model").alias("m1"), "label").join(lab.select(F.col("model").alias("m2"), "label"), "label")
    shared = met.groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("shared"))
    pairs = names.select(F.col("model").alias("m1")).crossJoin(F.broadcast(names.select(F.col("model").alias("m2"))))  # models x models
    return pairs.join(shared, ["m1", "m2"], "left").select("m1", "m2", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))


def by_source(objects: DataFrame) -> DataFrame:
    """JN-13: scene objects (source) under the detector's name."""
    spark = objects.sparkSession
    names = spark.createDataFrame(list(SOURCES), "model string, source string")
    return objects.join(F.broadcast(names), "source")
