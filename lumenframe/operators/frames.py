"""Frame series and per-image votes (IO-02, IO-13, WN-01..04, AG-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..sources.scratch import scratch_table


def positional(df: DataFrame, keys: list[str], order: list, out: str = "obj_idx") -> DataFrame:
    """WN-01: positions from 0 over a total order."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def sample_frames(df: DataFrame, every: int = 10, series: str = "series_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """IO-02, WN-04: every n-th frame of a series by its order."""
    return positional(df, [series], list(order), "position").where(F.col("position") % every == 0)


#: Frames whose fold is one array; series of no more frames are folded as a whole.
CHUNK = 64


def _fold(values: Column, start: Column, keep: float) -> Column:
    """f after the values in order, from f before them: null until there is a value; a
    value of null leaves it as it is."""
    step = lambda f, d: F.when(d.isNull(), f).when(f.isNull(), d).otherwise(keep * d + (1 - keep) * f)
    return F.aggregate(values, start, step)


def _running(start: Column, keep: float):
    """A step over structs (frame, d) that gathers the frames with f after each."""

    def step(so_far: Column, r: Column) -> Column:
        last = F.when(F.size(so_far) == 0, start).otherwise(F.element_at(so_far, -1)["filtered"])
        f = F.when(r["d"].isNull(), last).when(last.isNull(), r["d"]).otherwise(keep * r["d"] + (1 - keep) * last)
        return F.concat(so_far, F.array(F.struct(r["frame"].alias("frame"), f.alias("filtered"))))

    return step


def _starts(maps: DataFrame, chunk: int) -> DataFrame:
    """series, part, start: the value of a series before each of its parts.

    maps (series, part, m, c, first): over a part, f becomes m f + c, or first if there
    was none.  Neighbouring parts are composed to longer ones until a series is one part;
    the values then pass down again.  A row holds `chunk` parts at most."""
    upper = F.expr(f"part div {chunk}").alias("upper")
    ordered = F.array_sort(F.collect_list(F.struct("part", "m", "c", "first")))
    grouped = scratch_table(maps.groupBy("series", upper).agg(ordered.alias("parts")), "parts")
    pass_on = lambda f, p: F.when(f.isNull(), p["first"]).otherwise(p["m"] * f + p["c"])
    none = F.lit(None).cast("double")
    cut = scratch_table(grouped.groupBy("series").count().where("count > 1").select("series"), "cut_series")
    known = grouped.withColumn("start", none)
    if not cut.isEmpty():
        over = lambda start: F.aggregate("parts", start, lambda f, p: p["m"] * f + p["c"])
        longer = grouped.join(cut.hint("merge"), "series", "left_semi").select(
            "series", F.col("upper").alias("part"), F.aggregate("parts", F.lit(1.0), lambda m, p: m * p["m"]).alias("m"), over(F.lit(0.0)).alias("c"), F.aggregate("parts", none, pass_on).alias("first")
        )
        known = grouped.join(_starts(longer, chunk).withColumnRenamed("part", "upper").hint("merge"), ["series", "upper"], "left")

    def step(so_far: Column, p: Column) -> Column:
        before = F.struct(p["part"].alias("part"), so_far["f"].alias("start"))
        return F.struct(pass_on(so_far["f"], p).alias("f"), F.concat(so_far["out"], F.array(before)).alias("out"))

    empty = F.array().cast("array<struct<part:bigint,start:double>>")
    out = F.aggregate("parts", F.struct(F.col("start").alias("f"), empty.alias("out")), step, lambda s: s["out"])
    return known.select("series", F.explode(out).alias("p")).select("series", "p.part", "p.start")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `at`, their number in the order, without a gap.  The rows are sorted by
    ranges; the driver gets one count for each range."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch_table(sorted_.withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ordered")
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low")).orderBy("range").collect()
    before, shift = 0, []
    for r in counts:
        shift.append((r["range"], before - r["low"]))
        before += r["n"]
    shifts = rows.sparkSession.createDataFrame(shift, "range int, shift long")
    return placed.join(F.broadcast(shifts), "range").withColumn("at", F.col("at") + F.col("shift")).drop("range", "shift")


def ema_scan(df: DataFrame, keys: list[str], frame: str, value: str, cfg: Config = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """WN-02 for series of any length, by a scan over affine maps.

    Rows are ordered by ranges of (keys, frame, value) and cut into chunks of `chunk`
    rows, wherever a series starts.  A chunk is a map f -> m f + c; maps are composed
    level by level, and the value before each chunk then gives those of its frames.  So
    one long series keeps all tasks busy, and none holds it."""
    a = cfg.ema_keep
    slim = df.select(F.struct(*keys).alias("series"), F.col(frame).alias("frame"), F.col(value).cast("double").alias("d"))
    rows = F.array_sort(F.collect_list(F.struct("at", "frame", "d")))
    chunks = _numbered(slim, ["series", "frame", "d"]).groupBy("series", F.expr(f"at div {chunk}").alias("part")).agg(rows.alias("rows"))
    chunks = scratch_table(chunks, "chunks")
    values = F.transform("rows", lambda r: r["d"])
    n = F.size(F.filter(values, lambda d: d.isNotNull()))
    maps = chunks.select("series", "part", F.pow(F.lit(1 - a), n).alias("m"), _fold(values, F.lit(0.0), a).alias("c"), _fold(values, F.lit(None).cast("double"), a).alias("first"))
    met = chunks.join(_starts(maps, chunk).hint("merge"), ["series", "part"])
    return _opened(met, ["series"], "frame", F.col("start"), a).select(*[F.col("series")[k].alias(k) for k in keys], F.col("frame").alias(frame), "filtered")


def _opened(arrays: DataFrame, keys: list[str], frame: str, start: Column, keep: float) -> DataFrame:
    kind = arrays.schema["rows"].dataType.elementType["frame"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<frame:{kind},filtered:double>>")
    out = F.aggregate("rows", empty, _running(start, keep))
    return arrays.select(*keys, F.explode(out).alias("p")).select(*keys, F.col("p.frame").alias(frame), "p.filtered")


def ema(df: DataFrame, keys: list[str], frame: str, value: str, cfg: Config = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """WN-02: f0 = d0, ft = a dt + (1 - a) f(t-1), per key in frame order (rows of one
    frame by value).

    A frame without a value keeps the last f, and has none before the first value; such a
    frame comes first among those of its number.  Series of up to `chunk` frames are
    folded in one array each, longer ones by a scan."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    same = lambda s: [df[k].eqNullSafe(s[k]) for k in keys]
    long = scratch_table(size.where(F.col("_n") > chunk).select(*keys), "long_series")
    none = long.isEmpty()
    short = df if none else df.join(long, same(long), "left_anti")
    rows = F.array_sort(F.collect_list(F.struct(F.col(frame).alias("frame"), F.col(value).cast("double").alias("d"))))
    folded = _opened(short.groupBy(*keys).agg(rows.alias("rows")), keys, frame, F.lit(None).cast("double"), cfg.ema_keep)
    if none:
        return folded
    return folded.unionByName(ema_scan(df.join(long, same(long), "left_semi"), keys, frame, value, cfg, chunk))


def depth_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """IO-13: min, max and mean depth of each frame."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.min(v).alias("d_min"), F.max(v).alias("d_max"), F.bround(F.sum(v) / F.count(v), 4).alias("d_mean"))


def depth_documents(frames: DataFrame, key: str, frame: str, prefix: str, size: tuple[int, int]) -> DataFrame:
    """IO-13: one document per series of its frames' summaries in order, with a header."""
    one = F.struct(F.col(frame).alias("frame"), F.col("d_min").alias("min"), F.col("d_max").alias("max"), F.col("d_mean").alias("mean"))
    docs = frames.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("frames"))
    head = [F.lit(prefix).alias("model_prefix"), F.array(*map(F.lit, size)).alias("target_size"), F.size("frames").alias("num_frames")]
    return docs.select(key, F.to_json(F.struct(*head, "frames")).alias("document"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scene_vote(images: DataFrame, prompts: DataFrame) -> DataFrame:
    """AG-12: softmax over all prompts of an image, mean probability of each kind.

    The prompts are a fixed handful and broadcast; the image's logits stay in one row."""
    p = prompts.agg(F.array_sort(F.collect_list(F.struct("prompt_id", "kind", "prompt"))).alias("prompts"))
    both = images.crossJoin(F.broadcast(p))
    logit = F.transform("prompts", lambda q: F.struct(q["kind"].alias("kind"), dot(F.col("embedding"), q["prompt"]).alias("x")))
    rows = both.select("image_id", logit.alias("l"))
    rows = rows.select("image_id", "l", F.array_max(F.transform("l", lambda q: q["x"])).alias("top"))
    rows = rows.select("image_id", F.transform("l", lambda q: F.struct(q["kind"].alias("kind"), F.exp(q["x"] - F.col("top")).alias("e"))).alias("l"))

    def total(kind: str | None):
        of = F.filter("l", lambda q: q["kind"] == kind) if kind else F.col("l")
        return F.aggregate(of, F.lit(0.0), lambda s, q: s + q["e"]), F.size(of)

    (all_e, _), (in_e, in_n), (out_e, out_n) = total(None), total("indoor"), total("outdoor")
    rows = rows.select("image_id", (in_e / all_e / in_n).alias("p_in"), (out_e / all_e / out_n).alias("p_out"))
    return rows.select(
        "image_id", F.round("p_in", 6).alias("indoor_score"), F.round("p_out", 6).alias("outdoor_score"), F.when(F.col("p_in") >= F.col("p_out"), "indoor").otherwise("outdoor").alias("scene_type")
    )
