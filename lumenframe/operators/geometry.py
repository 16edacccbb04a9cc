"""Projections, geometry, cameras and grid values (PF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .regions import TILE, box_words, depth_range, gather_depth, met_pixels


def bound_side(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """PF-01: adds scale, out_w, out_h; the longer side is at most max_side."""
    longest = F.greatest("width", "height")
    scale = F.when(longest > cfg.max_side, cfg.max_side / longest).otherwise(1.0)
    fit = lambda c: F.bround(F.col(c) * F.col("scale")).cast("long")
    return df.withColumn("scale", scale).withColumns({"out_w": fit("width"), "out_h": fit("height")})


def resample_grid(depth: DataFrame, sizes: DataFrame, out_w: Column, out_h: Column) -> DataFrame:
    """PF-02: nearest-neighbour resampling of depth tiles; sizes(image_id, gw, gh).

    Each tile meets its image's sizes only, and gives the pixels of the result whose
    source lies in it: the rows and columns of those are ranges."""
    dest = sizes.select("image_id", "gw", "gh", out_w.cast("long").alias("ow"), out_h.cast("long").alias("oh")).where("ow > 0 and oh > 0")
    met = depth.join(dest, "image_id").where("py >= 0 and py < gh")
    # dy * gh div oh = py from the ceiling of py * oh / gh on
    from_y, to_y = F.expr("(py * oh + gh - 1) div gh"), F.expr("((py + 1) * oh + gh - 1) div gh")
    first = F.expr(f"(tx * {TILE} * ow + gw - 1) div gw")
    end = F.least(F.col("ow"), F.expr(f"((tx * {TILE} + {TILE}) * ow + gw - 1) div gw"))
    span = met.withColumns({"y0": from_y, "y1": to_y, "x0": first, "x1": end}).where("y0 < y1 and x0 < x1")
    rows = span.select("image_id", "gw", "ow", "tx", "x0", "x1", "depth", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("dy"))
    px = rows.select("image_id", "gw", "ow", "tx", "depth", "dy", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("dx"))
    at = (F.expr("dx * gw div ow") - F.col("tx") * TILE).cast("int")
    px = px.where(at < F.size("depth"))
    return px.select("image_id", F.col("dx").alias("px"), F.col("dy").alias("py"), F.get("depth", at).cast("long").alias("depth_mm"))


def clamp_box(df: DataFrame, w: Column, h: Column) -> DataFrame:
    """PF-03: x1, y1, x2, y2 inside the image."""
    zero = F.lit(0).cast("long")
    return df.withColumns(
        {"x1": F.greatest(zero, "x1"), "y1": F.greatest(zero, "y1"), "x2": F.least(w, "x2"), "y2": F.least(h, "y2")}
    )


def to_corners(df: DataFrame) -> DataFrame:
    """PF-04: xywh to xyxy."""
    return df.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")})


def to_extent(df: DataFrame) -> DataFrame:
    """PF-04 inverse: xyxy to xywh, sides floored at 0."""
    zero = F.lit(0).cast("long")
    return df.withColumns({"x": F.col("x1"), "y": F.col("y1"), "w": F.greatest(zero, F.col("x2") - F.col("x1")), "h": F.greatest(zero, F.col("y2") - F.col("y1"))})


def undo_scale(df: DataFrame, cols: list[str], scale: Column) -> DataFrame:
    """PF-05."""
    return df.withColumns({c: F.col(c) / scale for c in cols})


def area_or_box(mask_area: Column, w: Column, h: Column) -> Column:
    """PF-06: pixels of the mask, else the whole part of the box's area."""
    return F.coalesce(mask_area, F.floor(w * h).cast("long"))


def centroid(df: DataFrame, mask_x: str | None = None, mask_y: str | None = None) -> DataFrame:
    """PF-07: the mask's centroid, else the centre of the box, else the origin."""
    bx, by = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    pick = lambda m, b: F.coalesce(*([F.col(m).cast("double")] if m else []), b, F.lit(0.0))
    return df.withColumns({"ux": pick(mask_x, bx), "uy": pick(mask_y, by)})


def integer_box(df: DataFrame) -> DataFrame:
    """PF-08: corners rounded half to even."""
    return df.withColumns({c: F.bround(c).cast("int") for c in ("x1", "y1", "x2", "y2")})


def intrinsics(frames: DataFrame, cameras: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """PF-09: calibrated camera, then explicit fx, then the field of view.

    The principal point of a calibration stays as it is; otherwise it is the centre."""
    f = frames.join(cameras.select("camera_id", "fx", "fy", "cx", "cy"), "camera_id", "left")
    cal = F.col("fx").isNotNull() & F.col("fy").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull()
    fov = (F.col("width") / 2.0) / F.tan(F.radians(F.lit(cfg.fov_degrees)) / 2)
    return f.select(
        "image_id",
        "width",
        "height",
        F.when(cal, "calibration").when(F.col("fx").isNotNull(), "explicit").otherwise("fov").alias("k_source"),
        F.coalesce("fx", fov).alias("fx"),
        F.coalesce(F.when(F.col("fx").isNotNull(), F.coalesce("fy", "fx")), fov).alias("fy"),
        F.coalesce("cx", F.col("width") / 2.0).alias("cx"),
        F.coalesce("cy", F.col("height") / 2.0).alias("cy"),
    )


def distort(df: DataFrame) -> DataFrame:
    """PF-10: for a pixel (px, py) of the straight image, the source position under the
    lens model k1, k2, p1, p2 with fx, fy, cx, cy."""
    x, y = (F.col("px") - F.col("cx")) / F.col("fx"), (F.col("py") - F.col("cy")) / F.col("fy")
    df = df.withColumns({"nx": x, "ny": y}).withColumn("r2", F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))
    nx, ny, r2 = F.col("nx"), F.col("ny"), F.col("r2")
    radial = 1 + F.col("k1") * r2 + F.col("k2") * r2 * r2
    xd = nx * radial + 2 * F.col("p1") * nx * ny + F.col("p2") * (r2 + 2 * nx * nx)
    yd = ny * radial + F.col("p1") * (r2 + 2 * ny * ny) + 2 * F.col("p2") * nx * ny
    return df.withColumns({"src_x": xd * F.col("fx") + F.col("cx"), "src_y": yd * F.col("fy") + F.col("cy")}).drop("nx", "ny", "r2")


def back_project(u: Column, v: Column, z: Column) -> dict[str, Column]:
    """PF-11: camera coordinates, 3 decimals; fx, fy, cx, cy are columns."""
    return {
        "x_m": F.bround((u - F.col("cx")) * z / F.col("fx"), 3),
        "y_m": F.bround((v - F.col("cy")) * z / F.col("fy"), 3),
        "z_m": F.bround(z, 3),
    }


def score_gate(df: DataFrame, score: Column, track: Column, cfg: Config = DEFAULT) -> DataFrame:
    """PF-12: the second track has a threshold of its own."""
    return df.where(score >= F.when(track == "SAM3", cfg.track_threshold).otherwise(cfg.box_threshold))


def mask_quality(df: DataFrame, min_stability: float = 0.0, min_iou: float = 0.0, min_area: int = 0, max_fraction: float = 1.0) -> DataFrame:
    """PF-13: columns stability, predicted_iou, area, image_area.  Defaults pass all."""
    tests = []
    if min_stability > 0:
        tests.append(F.col("stability") >= min_stability)
    if min_iou > 0:
        tests.append(F.col("predicted_iou") >= min_iou)
    if min_area > 0:
        tests.append(F.col("area") >= min_area)
    if max_fraction < 1:
        tests.append(F.col("area") <= max_fraction * F.col("image_area"))
    for t in tests:
        df = df.where(t)
    return df


def is_degenerate() -> Column:
    """PF-14: a box without an interior."""
    return (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))


def scale_depth(depth: Column, factor: float = 1.0) -> Column:
    """PF-15."""
    return depth * F.lit(factor)


def is_finite(depth: Column) -> Column:
    """PF-20."""
    d = depth.cast("double")
    return depth.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))


def normalised(value: Column, lo: Column, hi: Column, top: float = 1.0, widen: float = 0.0) -> Column:
    """value from 0 to top between lo and hi.  A range of 0 gives 0, or with widen counts
    as that wide."""
    span = hi - lo
    return F.when(span == 0, (value - lo) * top / widen if widen else F.lit(0.0)).otherwise((value - lo) * top / span)


def normalise_under(words: DataFrame, depth: DataFrame, keys: list[str], top: float = 1.0, widen: float = 0.0) -> DataFrame:
    """PF-17, PF-18: keys, px, py, depth_mm and norm of the finite pixels under masks, by
    the extrema of each key, which a window over the words gives before those are taken
    apart: pixels are neither sorted nor kept."""
    over = Window.partitionBy(*keys)
    lo, hi = depth_range()
    met = words.join(depth, ["image_id", "py", "tx"]).select(*keys, "py", "tx", "bits", "depth", lo.alias("lo"), hi.alias("hi"))
    met = met.withColumns({"lo": F.min("lo").over(over), "hi": F.max("hi").over(over)})
    px = met_pixels(met, [*keys, "lo", "hi"]).where("depth_mm is not null")
    return px.select(*keys, "px", "py", "depth_mm", normalised(F.col("depth_mm"), F.col("lo"), F.col("hi"), top, widen).alias("norm"))


def normalise_grid(depth: DataFrame, top: float = 255.0) -> DataFrame:
    """PF-16, WN-05: image_id, px, py, depth_mm, norm by the extrema of each image, which a
    window over its tiles gives before those are taken apart into pixels."""
    over = Window.partitionBy("image_id")
    ext = depth.select("*", F.min(F.array_min("depth")).over(over).alias("lo"), F.max(F.array_max("depth")).over(over).alias("hi"))
    px = ext.select("image_id", "py", "tx", "lo", "hi", F.posexplode_outer("depth").alias("j", "depth_mm")).where("j is not null")
    norm = normalised(F.col("depth_mm"), F.col("lo"), F.col("hi"), top)
    return px.select("image_id", (F.col("tx") * TILE + F.col("j")).alias("px"), "py", "depth_mm", norm.alias("norm"))


def quantise16(depth_m: Column, indoor: Column) -> Column:
    """PF-19: depth over 20 m (indoor) or 80 m as 16 bits, cut off."""
    top = F.when(indoor, 20.0).otherwise(80.0)
    return F.floor(F.least(F.greatest(depth_m / top * 65535, F.lit(0.0)), F.lit(65535.0))).cast("int")


def crop(depth: DataFrame, boxes: DataFrame) -> DataFrame:
    """PF-21: the pixels of each box, half open: a box is a mask that meets the depth
    tiles it touches, and no others of its image."""
    return gather_depth(box_words(boxes), depth)
