"""Queries on the pixels of regions make the masks and the depth once."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ("ag03_sigma_clip", "ag05_snap", "ag06_inner_circle", "ag07_histogram_mode"))
def test_pixels_are_made_once(spark, name, capsys):
    """One join of masks and depth, and no table of regions that meets the pixels again:
    what holds for a region comes to its pixels by windows.  (Two erosions, one for masks
    that are eroded and one for those that are not, made the words several times.)"""
    entry.queries()[name](spark, SMALL).explain()
    plan = capsys.readouterr().out
    joins = re.findall(r"Join \[(.*?)\], \[", plan)
    assert [len(j.split(", ")) for j in joins].count(3) == 1, joins
    assert not any("obj_idx" in j for j in joins), joins
    assert "Union" not in plan


@pytest.mark.parametrize("name", ("pf16_normalise", "pf17_normalise_masked", "pf18_normalise_in_box"))
def test_pixels_are_not_sorted(spark, name, capsys):
    """What a window tells of an image or an object comes from its words or tiles: nothing
    sorts or keeps their pixels, and the tiles of boxes are not dealt a second time."""
    entry.queries()[name](spark, SMALL).explain()
    plan = capsys.readouterr().out
    above = plan[: plan.index("Generate posexplode")]
    assert "Sort" not in above and "Window" not in above, above
    assert plan.count("Exchange") <= 3


def test_both_masks_of_an_object_are_made_once(spark, capsys):
    """AG-10: windows add up words, not pixels; the words come from two dealings of rows
    (masks, and the depth's cover), objects from a third, sizes from a fourth or fifth."""
    entry.queries()["ag10_erosion_comparison"](spark, SMALL).explain()
    plan = capsys.readouterr().out
    above = plan[: plan.index("Generate posexplode")].splitlines()
    assert all("row_number" in line for line in above if "Window [" in line)
    assert plan.count("REPARTITION_BY_NUM") <= 6 and "Union" not in plan


@pytest.mark.parametrize("name", ("rg04_dilate", "rg05_ring", "ag03_sigma_clip", "ag04_weighted_centroid", "ag05_snap", "ag06_inner_circle", "ag10_erosion_comparison"))
def test_masks_are_eroded_as_lists(spark, name, capsys):
    """The words of an object are one list, read in the order of the objects: no window over
    the words, and nothing but the dilation puts them into hash tables."""
    entry.queries()[name](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert "collect_list(struct(py" in plan and "bit_and(" not in plan
    hashed = [line for line in plan.splitlines() if "HashAggregate(keys=[image_id" in line and "tx#" in line.split("functions")[0]]
    assert len(hashed) == (2 if name.startswith(("rg04", "rg05")) else 0), hashed


@pytest.mark.parametrize("name", ("ag02_depth_stats", "ag04_weighted_centroid", "ag11_grid_stats", "pf19_quantise"))
def test_tiles_are_covered_in_order(spark, name, capsys):
    """The 32 minima of a tile are not kept in a hash table, and tiles are not sorted by
    their places after them."""
    entry.queries()[name](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert re.search(r"SortAggregate\(key=\[image_id#\d+L?, py#\d+L?, tx", plan)
    assert not re.search(r"HashAggregate\(keys=\[image_id#\d+L?, py#\d+L?, tx", plan)


def test_counts_of_depths_stay_in_order(spark, capsys):
    """AG-02: pixels are sorted once by region and depth; counts, clip and median follow."""
    entry.queries()["ag02_depth_stats"](spark, SMALL).explain()
    plan = capsys.readouterr().out
    above = plan[: plan.index("Generate posexplode")]
    assert len(re.findall(r"\bSort \[", above)) == 1 and "HashAggregate" not in above, above


@pytest.mark.parametrize("name", ("ag03_sigma_clip", "ag04_weighted_centroid", "ag06_inner_circle"))
def test_sums_of_pixels_are_hashed(spark, name, capsys):
    """Few sums over many pixels: not one group after the other."""
    entry.queries()[name](spark, SMALL).explain()
    plan = capsys.readouterr().out
    above = plan[: plan.index("Generate posexplode")]
    assert above.count("HashAggregate") == 2 and "SortAggregate" not in above and "Exchange" not in above, above


@pytest.mark.parametrize("name", ("ag08_separation", "ag09_region_stats"))
def test_tiles_of_rings_are_those_of_the_union(spark, name, capsys):
    """What masks grow over is not put into the table of nearest masks, and is grown from
    the union of an image's masks."""
    entry.queries()[name](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert "Union" not in plan and "LeftOuter" in plan
