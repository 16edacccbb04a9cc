"""Tables of images, objects and pixels stay dealt by image."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
IN_PLACE = ("jn01_gather", "jn02_mask_iou", "jn04_dedup", "ag02_depth_stats", "ag09_region_stats", "ag11_grid_stats", "pf02_resample", "pf16_normalise", "pf17_normalise_masked", "pf19_quantise", "pf20_finite", "pf21_crop", "rg03_erode", "rg04_dilate")


@pytest.mark.parametrize("name", IN_PLACE)
def test_only_given_rows_are_moved(spark, name, capsys):
    """Every exchange is that of lineitem's or orders' rows: none is of words, tiles or
    pixels, nor a broadcast of them."""
    entry.queries()[name](spark, SMALL).explain()
    moved = re.findall(r"(?:Broadcast)?Exchange .*", capsys.readouterr().out)
    assert moved and all("REPARTITION_BY_NUM" in m for m in moved), moved


@pytest.mark.parametrize("name", ("jn09_subjects", "jn10_attach", "jn12_resolved_edges", "ag14_attach_counts"))
def test_objects_at_rest_stay_dealt(spark, name, capsys):
    """Objects and triplets are written once, dealt by image, and then nothing is moved."""
    entry.queries()[name](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert "Bucketed: true" in plan and "Exchange" not in plan


def test_images_of_a_camera_stay_dealt(spark, capsys):
    """Cameras go to the images: no task gets all images of a camera."""
    entry.queries()["pf09_intrinsics"](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert re.search(r"BroadcastHashJoin \[camera_id.*LeftOuter", plan) and not re.search(r"SortMergeJoin \[camera_id.*LeftOuter", plan)


def test_layers_stay_dealt(spark, capsys):
    """What captions tell meets the rows of lineitem; no object or pair is dealt by part."""
    entry.queries()["st02_layers"](spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert not re.search(r"Join \[part_id", plan)
