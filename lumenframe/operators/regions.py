"""Masks as tables of pixel words, and statistics of the depth under them (RG, AG-01..11).

At rest a mask is kept as run lengths.  For work it is a row for each 32 pixels of a grid
row that it touches: image_id, obj_idx, py, tx, and a bitmap `bits` whose lowest bit is
pixel 32 * tx.  Depth is a row for each 32 pixels of a grid row: image_id, py, tx, and an
array `depth` of integer millimetres, so that sums are exact in any order; outputs are in
metres.  Growing and shrinking a mask are shifts of words and bitwise aggregates, masks
and depth meet by an equi-join on (image_id, py, tx), and single pixels exist only where
statistics need them, after that join.  Statistics are keyed by (image_id, obj_idx).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

OBJ = ["image_id", "obj_idx"]
TILE = 32
WORD = [*OBJ, "py", "tx"]
ALL = (1 << TILE) - 1


def _bit(j: Column) -> Column:
    """1 shifted left by a column."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), j.cast("int"))


def _low_bits(n: Column) -> Column:
    """The lowest n bits of a word; n may lie outside the word."""
    return _bit(F.greatest(F.lit(0), F.least(F.lit(62), n))) - 1


# Forms of a mask


def run_lengths_to_pixels(df: DataFrame, keys: list[str], runs: str = "runs") -> DataFrame:
    """RG-01: runs array<struct<y, x0, len>> to pixel rows."""
    r = df.select(*keys, F.inline(runs))
    return r.select(*keys, F.explode(F.sequence("x0", F.col("x0") + F.col("len") - 1)).alias("px"), F.col("y").alias("py"))


def pixels_to_run_lengths(px: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse of RG-01; at rest a mask is kept as runs."""
    row = Window.partitionBy(*keys, "py").orderBy("px")
    runs = px.withColumn("run", F.col("px") - F.row_number().over(row)).groupBy(*keys, "py", "run").agg(F.min("px").alias("x0"), F.count(F.lit(1)).alias("len"))
    one = F.struct(F.col("py").alias("y"), "x0", "len")
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("runs"))


def run_lengths_to_words(df: DataFrame, runs: str = "runs") -> DataFrame:
    """Runs of (image_id, obj_idx) to words, without single pixels in between."""
    r = df.select(*OBJ, F.inline(runs)).select(*OBJ, F.col("y").alias("py"), "x0", (F.col("x0") + F.col("len")).alias("x1"))
    return ranges_to_words(r).groupBy(*WORD).agg(F.bit_or("bits").alias("bits"))


def ranges_to_words(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Half-open ranges x0, x1 of grid rows to words; ranges of a row may share a word."""
    tiles = F.sequence(F.floor(F.col("x0") / TILE), F.floor((F.col("x1") - 1) / TILE))
    r = rows.where("x1 > x0").select(*OBJ, "py", "x0", "x1", *keep, F.explode(tiles).alias("tx"))
    start = F.col("tx") * TILE
    return r.select(*WORD, *keep, (_low_bits(F.least(F.col("x1") - start, F.lit(TILE))) - _low_bits(F.col("x0") - start)).alias("bits"))


def words_to_pixels(words: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each pixel of a mask."""
    w = words.select(*OBJ, *keep, "py", "tx", "bits", F.explode(F.sequence(F.lit(0), F.lit(TILE - 1))).alias("j"))
    return w.where(F.getbit("bits", F.col("j")) == 1).select(*OBJ, *keep, (F.col("tx") * TILE + F.col("j")).alias("px"), "py")


def box_words(boxes: DataFrame) -> DataFrame:
    """A box x1, y1, x2, y2, half open, as a mask."""
    zero = F.lit(0).cast("long")
    b = boxes.where((F.col("y2") > 0) & (F.col("y2") > F.col("y1"))).select(*OBJ, F.greatest(zero, "x1").alias("x0"), F.col("x2").alias("x1"), F.explode(F.sequence(F.greatest(zero, "y1"), F.col("y2") - 1)).alias("py"))
    return ranges_to_words(b)


# Sizes


def _sizes(over: Window | None = None) -> dict[str, Column]:
    """Area and inclusive extents, as aggregates or over a window."""
    first = F.bit_count(F.col("bits").bitwiseAND(-F.col("bits")) - 1)
    last = F.length(F.bin("bits")) - 1
    start = F.col("tx") * TILE
    made = {"area": F.sum(F.bit_count("bits")), "x_min": F.min(start + first), "x_max": F.max(start + last), "y_min": F.min("py"), "y_max": F.max("py")}
    return {k: v.over(over) if over is not None else v for k, v in made.items()}


def extents(words: DataFrame) -> DataFrame:
    """AG-01: area and inclusive extents of each mask."""
    return words.groupBy(*OBJ).agg(*[c.alias(k) for k, c in _sizes().items()])


def erosion_size(cfg: Config = DEFAULT) -> Column:
    """RG-02: kernel size by the narrowest side of the extents."""
    if not cfg.adaptive_erosion or cfg.erosion == 0:
        return F.lit(cfg.erosion)
    side = F.least(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")) + 1
    table = F.when(side < 15, 0).when(side < 40, 1).when(side < 80, 2).when(side < 150, min(3, cfg.erosion))
    return table.otherwise(cfg.erosion)


def centroids(words: DataFrame) -> DataFrame:
    """image_id, obj_idx, mx, my: the mean position of each mask's pixels.  The positions
    in a word add up by counts of its bits under five patterns, one for each binary digit
    of a position."""
    digit = lambda d: sum(1 << j for j in range(TILE) if j >> d & 1)
    inside = sum((F.bit_count(F.col("bits").bitwiseAND(digit(d))) * (1 << d) for d in range(1, 5)), F.bit_count(F.col("bits").bitwiseAND(digit(0))))
    n = F.bit_count("bits")
    sums = words.groupBy(*OBJ).agg(F.sum(n).alias("n"), F.sum(inside + n * F.col("tx") * TILE).alias("x"), F.sum(n * F.col("py")).alias("y"))
    return sums.select(*OBJ, F.round(F.col("x") / F.col("n"), 6).alias("mx"), F.round(F.col("y") / F.col("n"), 6).alias("my"))


# Morphology


def _spread(words: DataFrame, wide: Column, left: int, keep: list[str]) -> DataFrame:
    """A wide word, which begins `left` pixels before its tile, as words of the tile and
    its neighbours; bits outside the image are cut off."""
    own = F.shiftright(wide, left).bitwiseAND(ALL)
    before = F.shiftleft(wide.bitwiseAND((1 << left) - 1), TILE - left)
    parts = F.array(*[F.struct((F.col("tx") + d).alias("tx"), b.alias("bits"), F.lit(d).alias("side")) for d, b in ((-1, before), (0, own), (1, F.shiftright(wide, TILE + left)))])
    out = words.select(*OBJ, "py", *keep, F.inline(parts)).where("tx >= 0")
    return out.withColumn("bits", F.col("bits").bitwiseAND(_low_bits(F.col("gw") - F.col("tx") * TILE))).where("bits <> 0")


#: The widest kernel of one step: a word and its margins are one number of 63 bits.  It
#: is odd, so that wider kernels are steps of it and a rest.
STEP = 31


def _step(words: str, k: Column, widest: int) -> tuple[Column, Callable[[str], Column]]:
    """Erosion of a list of words by k x k, from 2 to widest, in an image of gw x gh: along
    the rows, a column for the words sorted by py and tx; and then across them, for the
    name of the result, sorted by tx and py.  A word's neighbours are next to it in the
    list.  If rows between two are missing, nothing is left of either."""
    reach, lo, hi = widest // 2, -F.floor(k / 2), k - 1 - F.floor(k / 2)

    def along(w: Column, i: Column) -> Column:
        before, after = F.get(words, i - 1), F.get(words, i + 1)
        beside = lambda n, d: (n["py"] == w["py"]) & (n["tx"] == w["tx"] + d)
        halo = F.shiftleft(w["bits"], reach)
        halo = halo.bitwiseOR(F.when(beside(before, -1), F.shiftright(before["bits"], TILE - reach)).otherwise(0))
        halo = halo.bitwiseOR(F.when(beside(after, 1), F.shiftleft(after["bits"].bitwiseAND((1 << reach) - 1), TILE + reach)).otherwise(0))
        left = F.when(w["tx"] == 0, (1 << reach) - 1).otherwise(0).cast("long")
        right = F.lit((1 << TILE + 2 * reach) - 1) - _low_bits(F.least(F.col("gw") - w["tx"] * TILE + reach, F.lit(TILE + 2 * reach)))
        full, row = halo.bitwiseOR(left).bitwiseOR(right), w["bits"]
        for dx in range(-reach, widest - reach):
            if dx:
                row = row.bitwiseAND(F.when((lo <= dx) & (hi >= dx), F.shiftright(full, reach + dx)).otherwise(-1))
        return F.struct(w["tx"].alias("tx"), w["py"].alias("py"), row.bitwiseAND(ALL).alias("bits"))

    def across(rows: str) -> Column:
        def met(w: Column, i: Column) -> Column:
            bits = w["bits"]
            for dy in range(-reach, widest - reach):
                if dy:
                    n, at = F.get(rows, i + dy), w["py"] + dy
                    there = F.when((n["tx"] == w["tx"]) & (n["py"] == at), n["bits"]).otherwise(0)
                    bits = bits.bitwiseAND(F.when((lo <= dy) & (hi >= dy) & (at >= 0) & (at < F.col("gh")), there).otherwise(-1))
            return F.struct(w["py"].alias("py"), w["tx"].alias("tx"), bits.alias("bits"))

        return F.filter(F.transform(rows, met), lambda w: w["bits"] != 0)

    return F.array_sort(F.filter(F.transform(words, along), lambda w: w["bits"] != 0)), across


def erode(words: DataFrame, sizes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """RG-03: masks eroded by the adaptive kernel; sizes(image_id, gw, gh).  A mask of at
    most 4k² pixels, or one that would vanish, stays as it is.

    A pixel survives if all k² positions of its window that lie in the image are in the
    mask: an intersection of shifts along the rows, and then one across them.  A kernel
    wider than STEP is several kernels in turn.  The words of an object are one list, and
    only lists of masks to be eroded are worked on.  The join on the image is the only
    shuffle of masks, and comes in the order of the objects."""
    return _tried(words, sizes, cfg).select(*OBJ, F.inline(F.coalesce("small", "words"))).select(*WORD, "bits")


def _tried(words: DataFrame, sizes: DataFrame, cfg: Config) -> DataFrame:
    """A row for each mask and size of its image: its `words`, and `small`, those of the
    eroded mask; null if it is not eroded, or would vanish."""
    listed = F.collect_list(F.struct("py", "tx", "bits")).alias("words")
    w = words.sortWithinPartitions(*OBJ).groupBy(*OBJ).agg(*[c.alias(k) for k, c in _sizes().items()], listed)
    w = w.join(sizes.distinct() if cfg.erosion > 1 else sizes, "image_id")
    w = w.withColumn("k", erosion_size(cfg)).select(*OBJ, "words", "gw", "gh", F.when(F.col("area") > 4 * F.col("k") * F.col("k"), F.col("k")).otherwise(0).alias("k"))
    if cfg.erosion <= 1:
        return w.select(*OBJ, "words", F.lit(None).cast("array<struct<py:bigint,tx:bigint,bits:bigint>>").alias("small"))
    w = _merged(w)
    w, widest = w.withColumns({"left": F.col("k"), "small": F.when(F.col("k") > 1, F.array_sort("words"))}), cfg.erosion
    while widest > 1:
        step = min(widest, STEP)
        w = w.withColumn("k", F.least("left", F.lit(step)))
        along, across = _step("small", F.col("k"), step)
        more = F.col("k") > 1
        w = w.withColumn("rows", F.when(more, along)).withColumn("small", F.when(more, F.array_sort(across("rows"))).otherwise(F.col("small")))
        w, widest = w.withColumn("left", F.col("left") - F.col("k") + 1), widest - step + 1
    return w.select(*OBJ, "words", F.when(F.size("small") > 0, F.col("small")).alias("small"))


def _merged(objects: DataFrame) -> DataFrame:
    """Words of the same place of an object, if it has such, become one; the order of
    others does not change."""
    place = lambda w: w["py"] * (1 << 32) + w["tx"]
    repeated = F.size(F.array_distinct(F.transform("words", place))) < F.size("words")
    o = objects.withColumn("_all", F.when(repeated, F.array_sort("words")))
    begins = lambda i: (i == 0) | (place(F.get("_all", i)) != place(F.get("_all", i - 1)))
    o = o.withColumn("_first", F.when(F.col("_all").isNotNull(), F.filter(F.sequence(F.lit(0), F.size("_all") - 1), begins)))
    same = lambda i, n: F.slice("_all", i + 1, F.coalesce(F.get("_first", n + 1), F.size("_all")) - i)
    bits = lambda i, n: F.aggregate(same(i, n), F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(w["bits"]))
    one = lambda i, n: F.struct(F.get("_all", i)["py"].alias("py"), F.get("_all", i)["tx"].alias("tx"), bits(i, n).alias("bits"))
    return o.withColumn("words", F.coalesce(F.transform("_first", one), "words")).drop("_all", "_first")


def _grown(words: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Words of the k x k dilation, several for a place; `own` holds the mask itself.
    Dilations of STEP go before that of a wider kernel's rest."""
    mask = words.select(*WORD, F.col("bits").alias("own"))
    wider = k > STEP
    while k > STEP:
        words, k = dilate(words, sizes, STEP), k - STEP + 1
    lo, hi = -(k // 2), k - 1 - k // 2
    wide = F.col("bits")
    for d in range(1, k):
        wide = wide.bitwiseOR(F.shiftleft("bits", d))
    w = words.select(*WORD, "bits").join(sizes, "image_id").withColumn("mask", F.col("bits"))
    grown = _spread(w, wide, -lo, ["gw", "gh", "mask"])
    rows = grown.select(*OBJ, "tx", "bits", "mask", "side", "gh", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("dy"), "py")
    own = F.when((F.col("side") == 0) & (F.col("dy") == 0), F.col("mask")).otherwise(F.lit(0).cast("long"))
    out = rows.select(*OBJ, (F.col("py") + F.col("dy")).alias("py"), "tx", "bits", own.alias("own"), "gh").where("py >= 0 and py < gh").drop("gh")
    if not wider:
        return out
    zero = F.lit(0).cast("long")
    return out.withColumn("own", zero).unionByName(mask.select(*WORD, zero.alias("bits"), "own"))


def dilate(words: DataFrame, sizes: DataFrame, k: int = 5) -> DataFrame:
    """RG-04: k x k dilation, cut off at the image."""
    return _grown(words, sizes, k).groupBy(*WORD).agg(F.bit_or("bits").alias("bits"))


def with_ring(words: DataFrame, sizes: DataFrame, k: int = 5) -> DataFrame:
    """Each word of the dilated mask: the mask in `bits`, its border ring in `ring`."""
    both = _grown(words, sizes, k).groupBy(*WORD).agg(F.bit_or("bits").alias("grown"), F.bit_or("own").alias("bits"))
    return both.select(*WORD, "bits", F.col("grown").bitwiseAND(F.bitwise_not("bits")).alias("ring"))


def border_ring(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """RG-05, ST-03: the dilated mask without the mask."""
    return with_ring(words, sizes).where("ring <> 0").select(*WORD, F.col("ring").alias("bits"))


def union_of_masks(words: DataFrame) -> DataFrame:
    """RG-06, ST-04: what any mask of the image covers."""
    return words.groupBy("image_id", "py", "tx").agg(F.bit_or("bits").alias("bits"))


def union_window(pairs: DataFrame, ext: DataFrame, sizes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """RG-07: the padded window around two masks; pairs(image_id, a, b)."""
    cols = ("x_min", "x_max", "y_min", "y_max")
    side = lambda k: ext.select("image_id", F.col("obj_idx").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in cols])
    p = pairs.join(side("a"), ["image_id", "a"]).join(side("b"), ["image_id", "b"]).join(sizes, "image_id")
    pad, zero = cfg.union_pad, F.lit(0).cast("long")
    return p.select(
        "image_id", "a", "b",
        F.greatest(zero, F.least("a_x_min", "b_x_min") - pad).alias("x1"),
        F.greatest(zero, F.least("a_y_min", "b_y_min") - pad).alias("y1"),
        F.least(F.col("gw"), F.greatest("a_x_max", "b_x_max") + pad).alias("x2"),
        F.least(F.col("gh"), F.greatest("a_y_max", "b_y_max") + pad).alias("y2"),
    )


# Depth


def depth_pixels(depth: DataFrame) -> DataFrame:
    """A row for each pixel of the grid.  (An outer generator, here and below: before
    another one Spark tests the array's size, and computes the array once more for it.)"""
    d = depth.select("image_id", "py", "tx", F.posexplode_outer("depth").alias("j", "depth_mm"))
    return d.where("j is not null").select("image_id", (F.col("tx") * TILE + F.col("j")).alias("px"), "py", F.col("depth_mm").cast("long").alias("depth_mm"))


def gather_depth(words: DataFrame, depth: DataFrame, keys: list[str] = OBJ) -> DataFrame:
    """JN-01: the depth under each mask pixel."""
    return met_pixels(words.join(depth, ["image_id", "py", "tx"]), keys)


def met_pixels(met: DataFrame, keys: list[str]) -> DataFrame:
    """Words that met the depth, taken apart into pixels."""
    met = met.select(*keys, "py", "tx", "bits", F.posexplode_outer("depth").alias("j", "depth_mm"))
    return met.where(F.getbit("bits", F.col("j")) == 1).select(*keys, (F.col("tx") * TILE + F.col("j")).alias("px"), "py", F.col("depth_mm").cast("long").alias("depth_mm"))


def depth_range() -> tuple[Column, Column]:
    """The least and the greatest finite depth under `bits`, in one word."""
    some = [F.when(F.getbit("bits", F.lit(j)) == 1, F.get("depth", F.lit(j))) for j in range(TILE)]
    return F.least(*some), F.greatest(*some)


def clipped_here(n: Column, s: Column, q: Column, d: Column, cfg: Config) -> Column:
    """Whether d stays in AG-03, from the count, sum and sum of squares of its region.

    |d - S/n| < sigma * std is tested as |n d - S| < sigma * sqrt(n Q - S²)."""
    spread = F.sqrt((n * q - s * s).cast("double"))
    active = F.lit(cfg.sigma > 0) & (n >= cfg.min_clip_pixels) & (spread / n > 1e-3)
    return ~active | (F.abs(n * d - s) < cfg.sigma * spread)


def sigma_clip(px: DataFrame, keys: list[str] = OBJ, cfg: Config = DEFAULT) -> DataFrame:
    """AG-03: drops finite pixels at sigma deviations or more from their mean, once.

    Not for fewer than ten pixels, a constant region, or if fewer than five would stay."""
    over = Window.partitionBy(*keys)
    d = F.col("depth_mm")
    px = px.where(d.isNotNull()).withColumns(
        {"_n": F.count(F.lit(1)).over(over), "_s": F.sum(d).over(over), "_q": F.sum(d * d).over(over)}
    )
    px = px.withColumn("_in", clipped_here(F.col("_n"), F.col("_s"), F.col("_q"), d, cfg))
    if not _few_may_stay(cfg):
        return px.where("_in").drop("_n", "_s", "_q", "_in")
    px = px.withColumn("_left", F.sum(F.col("_in").cast("long")).over(over))
    return px.where(F.col("_in") | (F.col("_left") < cfg.min_inliers)).drop("_n", "_s", "_q", "_in", "_left")


def metres(mm: Column) -> Column:
    """Metres with 4 decimals, half up; a nudge keeps decimal ties on one side."""
    return F.floor(mm * 10 + 0.500001) / 10000


def by_hash(df: DataFrame, keys: list[str] = OBJ) -> DataFrame:
    """df, for a few sums by keys over many rows that are in their order: Spark is not told
    of the order (of the last key, an integer), as a hash table of sums is the faster."""
    return df.withColumn(keys[-1], F.call_function("shiftleft", F.col(keys[-1]), F.lit(0)))


def _few_may_stay(cfg: Config) -> bool:
    """Whether AG-03 could leave fewer than min_inliers.  By Chebyshev's inequality at
    least 1 - 1 / sigma² of min_clip_pixels or more stay, so only where sigma is small."""
    return not (cfg.sigma > 0 and (1 - 1 / cfg.sigma**2) * cfg.min_clip_pixels >= cfg.min_inliers)


def depth_counts(px: DataFrame, keys: list[str] = OBJ) -> DataFrame:
    """keys, depth_mm, n_px: how many pixels of a region have each finite depth.

    AG-02, AG-03 and AG-07 need no more than this.  It is combined before the shuffle and
    dealt by region and depth, so that the pixels of a huge region never meet in one task;
    a region has at most as many rows as its depths have millimetres.  Pixels are sorted
    once, and all that follows takes the counts in that order.  (A count alone would let
    Spark leave out the sort, and with it the order; the first depth does not.)"""
    d = F.col("depth_mm")
    some = px.where(d.isNotNull()).select(*keys, "depth_mm").sortWithinPartitions(*keys, "depth_mm")
    return some.groupBy(*keys, "depth_mm").agg(F.when(F.first(d).isNotNull(), F.count(F.lit(1))).alias("n_px"))


def clip_counts(counts: DataFrame, keys: list[str] = OBJ, cfg: Config = DEFAULT) -> DataFrame:
    """AG-03 on depth_counts: the counts that sigma_clip would leave.  (The windows name the
    depth for its order alone, which the median needs next.)"""
    over = Window.partitionBy(*keys).orderBy("depth_mm").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d, n = F.col("depth_mm"), F.col("n_px")
    c = counts.withColumns({"_n": F.sum(n).over(over), "_s": F.sum(d * n).over(over), "_q": F.sum(d * d * n).over(over)})
    c = c.withColumn("_in", clipped_here(F.col("_n"), F.col("_s"), F.col("_q"), d, cfg))
    if not _few_may_stay(cfg):
        return c.where("_in").select(*keys, "depth_mm", "n_px")
    c = c.withColumn("_left", F.sum(F.when(F.col("_in"), n).otherwise(0)).over(over))
    return c.where(F.col("_in") | (F.col("_left") < cfg.min_inliers)).select(*keys, "depth_mm", "n_px")


def depth_stats(px: DataFrame, keys: list[str] = OBJ) -> DataFrame:
    """AG-02: min, max, mean, median and population deviation, in metres."""
    return stats_of_counts(depth_counts(px, keys), keys)


def stats_of_counts(counts: DataFrame, keys: list[str] = OBJ) -> DataFrame:
    """AG-02 from depth_counts.  The median is the middle of the two depths at which the
    running count passes half of the pixels: no task holds the depths of a region."""
    d, n = F.col("depth_mm"), F.col("n_px")
    run = Window.partitionBy(*keys).orderBy("depth_mm")
    so_far, every = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = counts.withColumns({"_up_to": F.sum(n).over(so_far), "_n": F.sum(n).over(every)})
    low, high = (F.min(F.when(F.col("_up_to") > F.expr(rank), d)) for rank in ("(_n - 1) div 2", "_n div 2"))
    agg = c.groupBy(*keys).agg(
        F.min(d).alias("lo"), F.max(d).alias("hi"), F.sum(d * n).alias("s"), F.sum(d * d * n).alias("q"), F.sum(n).alias("n"), ((low + high) / 2).alias("med")
    )
    var = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")
    return agg.select(
        *keys,
        metres(F.col("lo")).alias("d_min"),
        metres(F.col("hi")).alias("d_max"),
        metres(F.col("s") / F.col("n")).alias("d_mean"),
        metres(F.col("med")).alias("d_median"),
        metres(F.sqrt(var) / F.col("n")).alias("d_std"),
        (F.col("s") / F.col("n")).alias("mean_mm"),
        F.col("n").alias("n_clipped"),
    )


def _six(c: Column) -> Column:
    """c with 6 decimals, half to even.  bround would go through decimals, for each pixel."""
    return F.rint(c * 1e6) / 1e6


def _weighted() -> dict[str, tuple[Column, Column]]:
    """Sum of weighted positions and of weights, for each side of the AG-04 centroid."""
    w = 1.0 / (F.col("depth_mm") / 1000.0 + 1e-6)
    return {"wx": (F.sum(F.col("px") * w), F.sum(w)), "wy": (F.sum(F.col("py") * w), F.sum(w))}


def weighted_centroid(px: DataFrame, keys: list[str] = OBJ) -> DataFrame:
    """AG-04: centroid with weights 1 / (depth + 1e-6), to 6 decimals."""
    return by_hash(px, keys).groupBy(*keys).agg(*[_six(s / w).alias(k) for k, (s, w) in _weighted().items()])


def with_distance(px: DataFrame, keys: list[str] = OBJ) -> DataFrame:
    """Adds wx, wy and d2, the squared distance from that weighted centroid, to 6 decimals.
    Pixels that come from sigma_clip are in the order of their regions already: they are
    made and sorted once."""
    over = Window.partitionBy(*keys)
    px = px.withColumns({k: _six(s.over(over) / w.over(over)) for k, (s, w) in _weighted().items()})
    dx, dy = F.col("px") - F.col("wx"), F.col("py") - F.col("wy")
    return px.withColumn("d2", _six(dx * dx + dy * dy))


def snap_centroid(px: DataFrame, keys: list[str] = OBJ) -> DataFrame:
    """AG-05, TK-05: the pixel nearest to the centroid; the first in row order on ties."""
    return px.groupBy(*keys).agg(F.min(F.struct("d2", "py", "px")).alias("m")).select(*keys, F.col("m.px").alias("u"), F.col("m.py").alias("v"))


def with_area(words: DataFrame) -> DataFrame:
    """Adds num_pixels, the area of the mask that a word belongs to."""
    return words.withColumn("num_pixels", F.sum(F.bit_count("bits")).over(Window.partitionBy(*OBJ)))


def inner_circle(px: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """AG-06: pixels in the circle around the unsnapped centroid that has the given part
    of the mask's area, num_pixels of each pixel."""
    if cfg.central_fraction >= 1:
        return px
    return px.where(F.col("d2") <= F.col("num_pixels") * cfg.central_fraction / math.pi)


def histogram_mode(px: DataFrame, keys: list[str] = OBJ) -> DataFrame:
    """AG-07: midpoint (mm) of the first fullest of clamp(n div 5, 10, 100) equal bins.

    Bins are counted in integers: least(bins - 1, (d - min) * bins div (max - min)).  A
    constant region has its range widened by half a metre on each side."""
    d, n, over = F.col("depth_mm"), F.col("n_px"), Window.partitionBy(*keys)
    c = depth_counts(px, keys).withColumns({"z_pixels": F.sum(n).over(over), "lo": F.min(d).over(over), "hi": F.max(d).over(over)})
    flat = F.col("lo") == F.col("hi")
    c = c.select(
        *keys, "depth_mm", "n_px", "z_pixels",
        F.when(flat, F.col("lo") - 500).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 500).otherwise(F.col("hi")).alias("hi"),
        F.greatest(F.lit(10), F.least(F.lit(100), F.expr("z_pixels div 5"))).alias("bins"),
    )
    binned = c.withColumn("b", F.least(F.col("bins") - 1, F.expr("(depth_mm - lo) * bins div (hi - lo)")))
    filled = binned.groupBy(*keys, "z_pixels", "lo", "hi", "bins", "b").agg(F.sum(n).alias("in_bin"))
    best = filled.groupBy(*keys, "z_pixels", "lo", "hi", "bins").agg(F.max_by("b", F.struct("in_bin", -F.col("b"))).alias("b"))
    return best.select(*keys, "z_pixels", (F.col("lo") + (2 * F.col("b") + 1) * (F.col("hi") - F.col("lo")) / (2.0 * F.col("bins"))).alias("z_mm"))


def separation(stats: DataFrame, ring_depth: DataFrame, keys: list[str] = OBJ, cfg: Config = DEFAULT) -> DataFrame:
    """AG-08: distance of the region's mean depth from that of its ring, and whether it is
    small; without a ring 0 and false.  stats(keys, mean_mm), ring_depth(keys, depth_mm)."""
    d = F.col("depth_mm")
    ring = ring_depth.where(d.isNotNull()).groupBy(*keys).agg((F.sum(d) / F.count(F.lit(1))).alias("ring_mm"))
    gap = F.abs(F.col("mean_mm") - F.col("ring_mm"))
    return stats.select(*keys, "mean_mm").join(ring, keys, "left").select(
        *keys, F.coalesce(metres(gap), F.lit(0.0)).alias("separation"), F.coalesce(gap < cfg.transparent_mm, F.lit(False)).alias("transparent")
    )


def _totals(mask: str) -> tuple[Column, Column, Column]:
    """Number, sum and sum of squares of the finite depths under a mask, in one word."""
    some = [F.when(F.getbit(mask, F.lit(j)) == 1, F.get("depth", F.lit(j)).cast("long")) for j in range(TILE)]
    add = lambda values: reduce(lambda a, b: a + b, values)
    zero = F.lit(0).cast("long")
    return add([F.when(d.isNotNull(), 1).otherwise(0) for d in some]), add([F.coalesce(d, zero) for d in some]), add([F.coalesce(d * d, zero) for d in some])


#: Columns of region_stats that need the border ring.
OF_RING = ("transparent", "separation")


def region_stats(objects: DataFrame, words: DataFrame, depth: DataFrame, sizes: DataFrame, cfg: Config = DEFAULT, eroded: bool = True, ring: bool = True) -> DataFrame:
    """AG-02..09 in one chain: a row per object, also for those without a usable pixel,
    which get zeros, the centre of the grid and a null z.  Without the ring, the columns
    OF_RING are left out.

    Mask and ring come from one aggregate of words and meet the depth once.  Each word
    gives the totals of the depths under both, and windows over the words add them up for
    the object; only then the words are taken apart into mask pixels.  All that follows
    are windows and aggregates over the object.  Give words and depth dealt by image_id, so
    that pixels stay where the words are."""
    over = Window.partitionBy(*OBJ)
    mask = erode(words, sizes, cfg) if eroded else words.select(*WORD, "bits")
    met = (with_ring(mask, sizes) if ring else mask).join(depth, ["image_id", "py", "tx"])
    met = met.withColumn("bits", F.col("bits").bitwiseAND(_low_bits(F.size("depth"))))
    totals = dict(zip(("n0", "s0", "q0"), _totals("bits"), strict=True)) | {"num_pixels": F.bit_count("bits")}
    if ring:
        totals |= dict(zip(("ring_n", "ring_s"), _totals("ring"), strict=False))
    met = met.select(*OBJ, "py", "tx", "bits", "depth", *[c.alias(k) for k, c in totals.items()])
    met = met.withColumns({k: F.sum(k).over(over) for k in totals})
    px = met.select(*OBJ, "py", "tx", "bits", *totals, F.posexplode_outer("depth").alias("j", "d")).where((F.getbit("bits", F.col("j")) == 1) & F.col("d").isNotNull())
    px = px.select(*OBJ, (F.col("tx") * TILE + F.col("j")).alias("px"), "py", F.col("d").cast("long").alias("d"), *totals)
    d = F.col("d")
    px = px.withColumn("in", clipped_here(F.col("n0"), F.col("s0"), F.col("q0"), d, cfg))
    if _few_may_stay(cfg):
        px = px.withColumn("in", F.col("in") | (F.count_if("in").over(over) < cfg.min_inliers))
    c = px.where("in").drop("in", "n0", "s0", "q0")
    w = 1.0 / (d / 1000.0 + 1e-6)
    c = c.withColumns({k: _six(F.sum(F.col(p) * w).over(over) / F.sum(w).over(over)) for k, p in (("wx", "px"), ("wy", "py"))})
    dx, dy = F.col("px") - F.col("wx"), F.col("py") - F.col("wy")
    c = c.withColumn("d2", _six(dx * dx + dy * dy))
    inner = F.lit(cfg.central_fraction >= 1) | (F.col("d2") <= F.col("num_pixels") * cfg.central_fraction / math.pi)
    c = c.withColumn("inner_mm", F.when(inner, d))
    c = c.withColumns({"z_lo": F.min("inner_mm").over(over), "z_hi": F.max("inner_mm").over(over), "z_pixels": F.count("inner_mm").over(over)})
    flat = F.col("z_lo") == F.col("z_hi")
    c = c.withColumns(
        {
            "bins": F.greatest(F.lit(10), F.least(F.lit(100), F.expr("z_pixels div 5"))),
            "z_lo": F.when(flat, F.col("z_lo") - 500).otherwise(F.col("z_lo")),
            "z_hi": F.when(flat, F.col("z_hi") + 500).otherwise(F.col("z_hi")),
        }
    )
    place = F.least(F.col("bins") - 1, F.expr("(inner_mm - z_lo) * bins div (z_hi - z_lo)"))
    c = c.withColumn("bin", F.when(F.col("inner_mm").isNotNull(), place))
    same = {"ring_of": ("ring_s", "ring_n")} if ring else {}
    same["z_of"] = ("z_lo", "z_hi", "bins", "z_pixels")
    stats = c.groupBy(*OBJ).agg(
        F.min(d).alias("lo"), F.max(d).alias("hi"), F.sum(d).alias("s"), F.sum(d * d).alias("q"), F.count(F.lit(1)).alias("n"), F.percentile(d, F.lit(0.5)).alias("med"),
        F.min(F.struct("d2", "py", "px")).alias("near"), F.mode("bin", True).alias("bin"), F.max("num_pixels").alias("num_pixels"), *[F.first(F.struct(*v)).alias(k) for k, v in same.items()],
    ).select("*", *[f"{k}.*" for k in same]).drop(*same)
    out = objects.select(*OBJ).join(sizes, "image_id").join(stats, OBJ, "left")
    some, var = F.col("n").isNotNull(), (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")
    mean = F.col("s") / F.col("n")
    gap = F.when(F.col("ring_n") > 0, F.abs(mean - F.col("ring_s") / F.col("ring_n"))) if ring else F.lit(None)
    mode = F.col("z_lo") + (2 * F.col("bin") + 1) * (F.col("z_hi") - F.col("z_lo")) / (2.0 * F.col("bins"))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    made = out.select(
        *OBJ,
        zero(metres(F.col("lo")), "d_min"),
        zero(metres(F.col("hi")), "d_max"),
        zero(metres(mean), "d_mean"),
        zero(metres(F.col("med")), "d_median"),
        zero(metres(F.sqrt(var) / F.col("n")), "d_std"),
        F.when(some, F.col("num_pixels")).otherwise(0).cast("long").alias("num_pixels"),
        F.when(some, metres(F.coalesce(mode, "med"))).alias("z_val"),
        F.when(some, F.when(F.col("z_pixels") > 0, F.col("z_pixels")).otherwise(F.col("n"))).otherwise(0).cast("long").alias("z_val_pixels"),
        F.coalesce(gap < cfg.transparent_mm, F.lit(False)).alias("transparent"),
        zero(metres(gap), "separation"),
        F.coalesce("near.px", F.expr("gw div 2")).cast("long").alias("u"),
        F.coalesce("near.py", F.expr("gh div 2")).cast("long").alias("v"),
    )
    return made if ring else made.drop(*OF_RING)


def erosion_comparison(objects: DataFrame, words: DataFrame, depth: DataFrame, sizes: DataFrame, cfg: Config = DEFAULT, only: tuple[str, ...] | None = None) -> DataFrame:
    """AG-10: statistics with and without erosion side by side; all of region_stats, or
    only those named.  The ring is made only for those that need it.

    Both masks of an object go through one chain, as objects 2 i (eroded) and 2 i + 1, so
    that the words are made once, and the depth is read and met once."""
    twin = lambda k: (F.col("obj_idx") * 2 + k).alias("obj_idx")
    kinds = F.inline(F.array(F.struct(F.coalesce("small", "words").alias("words"), F.lit(0).alias("kind")), F.struct(F.col("words"), F.lit(1).alias("kind"))))
    masks = _tried(words, sizes, cfg).select(*OBJ, kinds).select("image_id", twin(F.col("kind")), F.inline("words"))
    both = objects.select("image_id", F.explode(F.array(twin(0), twin(1))).alias("obj_idx"))
    stats = region_stats(both, masks, depth, sizes, cfg, False, ring=only is None or any(c in OF_RING for c in only))
    raw = F.col("obj_idx") % 2 == 1
    names = only or [c for c in stats.columns if c not in OBJ]
    sides = [F.max(F.when(side, F.col(c))).alias(f"{head}{c}") for side, head in ((~raw, ""), (raw, "raw_")) for c in names]
    return stats.groupBy("image_id", F.expr("obj_idx div 2").alias("obj_idx")).agg(*sides)


def tile_sum(of: Callable[[Column], Column]) -> Column:
    """The sum of a value, as of an array's element, over the places of a tile."""
    return reduce(lambda a, b: a + b, [F.coalesce(of(F.get("depth", F.lit(j))).cast("long"), F.lit(0)) for j in range(TILE)])


def grid_stats(depth: DataFrame) -> DataFrame:
    """AG-11: min, max and mean depth of an image, in metres, from depth tiles: each tile
    is one row of partial results, and is never taken apart.  Images without a finite
    depth have no row."""
    s, n = tile_sum(lambda d: d), tile_sum(lambda d: d.isNotNull().cast("int"))
    tiles = depth.select("image_id", F.array_min("depth").alias("lo"), F.array_max("depth").alias("hi"), n.alias("n"), s.alias("s"))
    found = tiles.groupBy("image_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return found.where("n > 0").select("image_id", metres(F.col("lo")).alias("d_min"), metres(F.col("hi")).alias("d_max"), metres(F.col("s") / F.col("n")).alias("d_mean"))
