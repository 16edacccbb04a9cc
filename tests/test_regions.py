"""Hand-made masks: erosion, dilation, clipping, histogram, defaults."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lumenframe.config import Config
from lumenframe.operators import regions as Q


def square(x0, y0, w, h, obj=0):
    return [(0, obj, x, y) for y in range(y0, y0 + h) for x in range(x0, x0 + w)]


@pytest.fixture
def px(spark):
    return lambda rows: spark.createDataFrame(rows, "image_id long, obj_idx long, px long, py long")


@pytest.fixture
def sizes(spark):
    return lambda n: spark.createDataFrame([(0, n, n)], "image_id long, gw long, gh long")


@pytest.fixture
def words(spark, px):
    """A mask as words, by way of its run lengths."""
    return lambda rows: Q.run_lengths_to_words(Q.pixels_to_run_lengths(px(rows), Q.OBJ))


def as_set(df):
    px = Q.words_to_pixels(df) if "bits" in df.columns else df
    got = [(r.px, r.py) for r in px.collect()]
    assert len(set(got)) == len(got)
    return set(got)


def tiles(spark, w, h, value):
    """A grid whose pixels are value(x, y)."""
    rows = [(0, y, t, [value(x, y) for x in range(32 * t, min(w, 32 * t + 32))]) for y in range(h) for t in range(-(-w // 32))]
    return spark.createDataFrame(rows, "image_id long, py long, tx long, depth array<long>")


def plain_erosion(mask, k, n):
    lo, hi = -(k // 2), k - 1 - k // 2
    ok = lambda x, y: all((x + i, y + j) in mask for i in range(lo, hi + 1) for j in range(lo, hi + 1) if 0 <= x + i < n and 0 <= y + j < n)
    return {p for p in mask if ok(*p)}


@pytest.mark.parametrize("k", [31, 32, 33, 64, 101])
def test_wide_kernels(words, sizes, k):
    """Erosion and dilation by kernels wider than a step, even ones too, against sums over
    windows that the image cuts off."""
    import numpy as np

    n = 330
    mask = np.zeros((n, n), bool)
    mask[0:260, 20:300] = True
    mask[100, 150] = mask[3, 29] = False
    lo, hi = -(k // 2), k - 1 - k // 2

    def windows(m):
        total = np.zeros((n + 1, n + 1), int)
        total[1:, 1:] = m.cumsum(0).cumsum(1)
        at = np.arange(n)
        a, b = np.clip(at + lo, 0, n), np.clip(at + hi + 1, 0, n)
        c, d = np.clip(at - hi, 0, n), np.clip(at - lo + 1, 0, n)
        box = lambda p, q: total[np.ix_(q, q)] - total[np.ix_(p, q)] - total[np.ix_(q, p)] + total[np.ix_(p, p)]
        return box(a, b) == np.outer(b - a, b - a), box(c, d) > 0

    rows = [(0, 0, x, y) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True)]
    eroded, grown = windows(mask)
    eroded &= mask
    cells = lambda m: {(x, y) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(m)), strict=True)}
    w = words(rows)
    want = cells(eroded) if mask.sum() > 4 * k * k and eroded.any() else cells(mask)
    assert as_set(Q.erode(w, sizes(n), Config(erosion=k, adaptive_erosion=False))) == want
    assert as_set(Q.dilate(w, sizes(n), k)) == cells(grown)
    assert as_set(Q.with_ring(w, sizes(n), k).where("ring <> 0").select(*Q.WORD, F.col("ring").alias("bits"))) == cells(grown & ~mask)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
@pytest.mark.parametrize("at,n", [(0, 20), (3, 20), (25, 41), (25, 64), (52, 64)])
def test_erosion_of_each_size(words, sizes, k, at, n):
    """At the image's borders, and across the border of two words."""
    rows = [r for r in square(at, at, 12, 12) if (r[2] * 3 + r[3]) % 29]
    mask = {(r[2], r[3]) for r in rows}
    got = as_set(Q.erode(words(rows), sizes(n), Config(erosion=k, adaptive_erosion=False)))
    want = plain_erosion(mask, k, n) if len(mask) > 4 * k * k else mask
    assert got == (want or mask)


def test_erosion_leaves_small_and_vanishing_masks(words, sizes):
    small = square(5, 5, 4, 4)
    assert as_set(Q.erode(words(small), sizes(20), Config(erosion=2, adaptive_erosion=False))) == {(r[2], r[3]) for r in small}
    line = [(0, 0, x, 7) for x in range(30)]
    assert as_set(Q.erode(words(line), sizes(40), Config(erosion=2, adaptive_erosion=False))) == {(r[2], r[3]) for r in line}


@pytest.mark.parametrize("side,k", [(14, 0), (15, 1), (39, 1), (40, 2), (79, 2), (80, 3), (149, 3), (150, 5)])
def test_erosion_size_table(words, side, k):
    corners = [(0, 0, 0, 0), (0, 0, side - 1, 400), (0, 0, 3, 3)]
    got = Q.extents(words(corners)).select("*", Q.erosion_size().alias("k")).first()
    assert got.k == k and (got.area, got.x_min, got.x_max, got.y_min, got.y_max) == (3, 0, side - 1, 0, 400)


@pytest.mark.parametrize("n", [10, 33, 64, 65])
def test_dilation_and_ring(words, sizes, n):
    points = {(0, 0), (9, 5), (n - 1, n - 1), (min(31, n - 2), 3)}
    rows = [(0, 0, x, y) for x, y in points]
    want = {(x, y) for a, b in points for x in range(a - 2, a + 3) for y in range(b - 2, b + 3) if 0 <= x < n and 0 <= y < n}
    assert as_set(Q.dilate(words(rows), sizes(n))) == want
    assert as_set(Q.border_ring(words(rows), sizes(n))) == want - points


def test_runs_and_back(px, words):
    rows = [r for r in square(2, 3, 90, 4) if r[2] % 4]
    runs = Q.pixels_to_run_lengths(px(rows), Q.OBJ)
    assert runs.count() == 1 and len(runs.first().runs) == 4 * 23
    assert as_set(Q.run_lengths_to_pixels(runs, Q.OBJ)) == {(r[2], r[3]) for r in rows} == as_set(words(rows))


def test_box_crop_is_half_open(spark):
    from lumenframe.operators.geometry import crop

    boxes = spark.createDataFrame([(0, 0, -3, -2, 5, 1), (0, 1, 30, 2, 34, 4), (0, 2, 4, 4, 4, 9), (0, 3, 60, 0, 70, 1)], "image_id long, obj_idx long, x1 long, y1 long, x2 long, y2 long")
    got = {(r.obj_idx, r.px, r.py): r.depth_mm for r in crop(tiles(spark, 66, 5, lambda x, y: 100 * x + y), boxes).collect()}
    want = {(0, x, 0) for x in range(5)} | {(1, x, y) for x in range(30, 34) for y in (2, 3)} | {(3, x, 0) for x in range(60, 66)}
    assert set(got) == want and all(v == 100 * x + y for (_, x, y), v in got.items())


@pytest.mark.parametrize("w,h,ow,oh", [(64, 6, 32, 2), (70, 5, 23, 5), (40, 4, 80, 9)])
def test_resampling_takes_the_nearest_source(spark, w, h, ow, oh):
    from lumenframe.operators.geometry import resample_grid

    sizes = spark.createDataFrame([(0, w, h)], "image_id long, gw long, gh long")
    got = {(r.px, r.py): r.depth_mm for r in resample_grid(tiles(spark, w, h, lambda x, y: 100 * x + y), sizes, F.lit(ow), F.lit(oh)).collect()}
    assert got == {(x, y): 100 * (x * w // ow) + y * h // oh for x in range(ow) for y in range(oh)}


def depths(spark, values):
    return spark.createDataFrame([(0, 0, i, 0, v) for i, v in enumerate(values)], "image_id long, obj_idx long, px long, py long, depth_mm long")


def test_sigma_clip(spark):
    count = lambda v, **k: Q.sigma_clip(depths(spark, v), cfg=Config(**k)).count()
    assert count([1000] * 8 + [9000]) == 9  # too few pixels
    assert count([1000] * 30) == 30  # constant
    assert count([1000] * 30 + [9000]) == 30
    assert count([1000] * 30 + [None]) == 30
    assert count(list(range(0, 20000, 1000)), sigma=0.05) == 20  # fewer than five would stay
    assert count([800] * 200 + [2500] * 50) == 200  # |2500 - 1140| = 1360 is not under 2 * 680


def test_counts_give_what_pixels_give(spark):
    rng = random.Random(5)
    regions = {0: [rng.gauss(3000, 400) // 1 for _ in range(3000)], 1: [700] * 40 + [5000], 2: [1200, None, 1201], 3: [None], 4: [9], 5: [rng.randrange(100, 9000) for _ in range(998)]}
    rows = [(0, k, i, 0, None if v is None else int(v)) for k, vs in regions.items() for i, v in enumerate(vs)]
    px = spark.createDataFrame(rows, "image_id long, obj_idx long, px long, py long, depth_mm long")
    for cfg in (Config(), Config(sigma=0.05), Config(sigma=0.0)):
        kept = {k: sorted(r.depth_mm for r in Q.sigma_clip(px, cfg=cfg).where(F.col("obj_idx") == k).collect()) for k in regions}
        counts = Q.clip_counts(Q.depth_counts(px), cfg=cfg)
        assert {k: sorted(r.depth_mm for r in counts.where(F.col("obj_idx") == k).collect() for _ in range(r.n_px)) for k in regions} == kept
    got = {r.obj_idx: r for r in Q.depth_stats(px).collect()}
    assert sorted(got) == [0, 1, 2, 4, 5]  # no row without a finite depth
    for k, r in got.items():
        v = [int(x) for x in regions[k] if x is not None]
        assert (r.n_clipped, r.d_min, r.d_max) == (len(v), min(v) / 1000, max(v) / 1000)
        assert (r.d_median, r.d_mean, r.d_std) == pytest.approx((statistics.median(v) / 1000, statistics.fmean(v) / 1000, statistics.pstdev(v) / 1000), abs=6e-5)
    assert Q.depth_stats(px.limit(0)).count() == Q.histogram_mode(px.limit(0)).count() == 0


def test_counts_combine_before_the_shuffle(spark, capsys):
    Q.depth_stats(depths(spark, [1, 2, 3])).explain()
    assert "partial_count" in capsys.readouterr().out


def test_erosion_comparison_is_two_chains_side_by_side(spark, words, sizes):
    objects = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "image_id long, obj_idx long")
    masks = words(square(0, 0, 4, 4) + square(6, 6, 12, 13, 1))
    depth = tiles(spark, 20, 20, lambda x, y: None if x < 5 else 1500 + 7 * x + y)
    got = {r.obj_idx: r for r in Q.erosion_comparison(objects, masks, depth, sizes(20)).collect()}
    for eroded, head in ((True, ""), (False, "raw_")):
        for r in Q.region_stats(objects, masks, depth, sizes(20), eroded=eroded).collect():
            assert all(got[r.obj_idx][head + c] == r[c] for c in r.asDict() if c not in Q.OBJ)
    assert len(got) == 3


def test_grid_stats_of_tiles(spark):
    rows = [(0, 0, 0, [None] * 32), (0, 0, 1, [5] * 31 + [None]), (0, 1, 0, [36] * 32), (1, 0, 0, [None] * 32)]
    got = Q.grid_stats(spark.createDataFrame(rows, "image_id long, py long, tx long, depth array<int>")).collect()
    assert [(r.image_id, r.d_min, r.d_max, r.d_mean) for r in got] == [(0, 0.005, 0.036, 0.0207)]


def test_histogram_mode(spark):
    mode = lambda v: Q.histogram_mode(depths(spark, v)).first().z_mm
    assert mode([1000] * 12) == 1000 - 500 + 5.5 * 100
    assert mode([0] * 3 + [90] * 2 + [100]) == 5  # ties: the first bin
    assert mode([0, 95, 95, 100]) == 95


def test_region_stats_of_an_object_without_depth(spark, words, sizes):
    objects = spark.createDataFrame([(0, 0), (0, 1)], "image_id long, obj_idx long")
    depth = tiles(spark, 20, 20, lambda x, y: None if x < 5 else 1500)
    got = {r.obj_idx: r for r in Q.region_stats(objects, words(square(0, 0, 4, 4) + square(8, 8, 5, 5, 1)), depth, sizes(20)).collect()}
    assert (got[0].d_mean, got[0].num_pixels, got[0].z_val, got[0].u, got[0].v, got[0].transparent) == (0.0, 0, None, 10, 10, False)
    assert (got[1].d_mean, got[1].num_pixels, got[1].u, got[1].v, got[1].transparent) == (1.5, 25, 10, 10, True)


def test_masks_grow_and_shrink(spark, px, words, sizes):
    rows = [r for r in square(1, 1, 14, 13) if (r[2] + 5 * r[3]) % 17]
    mask = {(r[2], r[3]) for r in rows}
    small = as_set(Q.erode(words(rows), sizes(16), Config(erosion=3, adaptive_erosion=False)))
    assert small <= mask <= as_set(Q.dilate(words(rows), sizes(16)))
    clip = Q.sigma_clip(px(rows).withColumn("depth_mm", F.col("px") * F.col("py")))
    assert as_set(clip) <= mask


def test_erosion_of_words_that_share_a_place(spark, sizes):
    """Objects of one id: their words of a place become one, whether they are eroded or not;
    an image that is listed twice changes nothing."""
    box = lambda x0, x1, y0, y1, obj: [(0, obj, x0, x1, y) for y in range(y0, y1)]
    rows = box(2, 40, 0, 20, 0) + box(30, 70, 3, 25, 0) + box(5, 8, 5, 8, 1) + box(6, 9, 5, 8, 1)
    words = Q.ranges_to_words(spark.createDataFrame(rows, "image_id long, obj_idx long, x0 long, x1 long, py long"))
    mask = {(x, y) for _, k, a, b, y in rows if k == 0 for x in range(a, b)}
    small = {(x, y) for _, k, a, b, y in rows if k == 1 for x in range(a, b)}
    got = Q.erode(words, sizes(72).unionAll(sizes(72)), Config(erosion=3, adaptive_erosion=False))
    assert as_set(got.where("obj_idx = 0")) == plain_erosion(mask, 3, 72)
    assert as_set(got.where("obj_idx = 1")) == small
