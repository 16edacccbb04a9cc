"""Pairs, neighbours, relations and triplets on small tables; plans without nested loops."""

from __future__ import annotations

import random

import pytest

from lumenframe.config import Config
from lumenframe.operators import evaluate as E
from lumenframe.operators import pairs as P
from lumenframe.operators import relations as R


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(1)
    rows = []
    for i in range(4):
        for k in range(25):
            x, y = rng.randint(0, 700), rng.randint(0, 700)
            rows.append((i, k, x, y, x + rng.randint(0, 400), y + rng.randint(0, 400)))
    df = spark.createDataFrame(rows, "image_id long, obj_idx long, x1 long, y1 long, x2 long, y2 long")
    return rows, df


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return w * h / (area(a) + area(b) - w * h + 1e-8)


@pytest.mark.parametrize("tile", [1, 64, 256, 10_000])
def test_box_iou_with_any_tile(boxes, tile):
    rows, df = boxes
    if tile == 1:
        rows = [r for r in rows if r[0] == 0 and r[1] < 6]
        df = df.where("image_id = 0 and obj_idx < 6")
    got = {(r.image_id, r.a, r.b): r.iou for r in P.box_iou_pairs(df, Config(tile=tile)).collect()}
    want = {(a[0], a[1], b[1]): iou(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and iou(a, b) > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert all(0 < v <= 1 and got[i, b, a] == v for (i, a, b), v in got.items())


def pixels(spark, masks):
    rows = [(i, o, s, y, 0, ((1 << w) - 1) << x0) for i, o, s, x0, y0, w, h in masks for y in range(y0, y0 + h)]
    return spark.createDataFrame(rows, "image_id long, obj_idx long, segmentor string, py long, tx long, bits long")


def test_dedup_is_idempotent(spark):
    masks = [(0, 0, "GroundedSAM2", 0, 0, 10, 10), (0, 1, "SAM2_AMG", 0, 0, 10, 9), (0, 2, "SAM2_AMG", 5, 0, 10, 10), (0, 3, "SAM3", 0, 0, 10, 10), (1, 0, "SAM2_AMG", 0, 0, 3, 3)]
    px = pixels(spark, masks)
    objects = px.select("image_id", "obj_idx", "segmentor").distinct().union(spark.createDataFrame([(1, 9, "GroundedSAM2")], "image_id long, obj_idx long, segmentor string"))
    once = P.dedup_masks(objects, px)
    assert {(r.image_id, r.obj_idx, r.origin) for r in once.collect()} == {(0, 0, "primary"), (0, 2, "survivor"), (1, 0, "survivor")}
    again = P.dedup_masks(once.drop("origin"), px.join(once.select("image_id", "obj_idx"), ["image_id", "obj_idx"], "left_semi"))
    assert again.count() == 3


def test_bounds_leave_few_pairs_and_all_victims(spark):
    """Random masks: the pairs that bounds leave, of those that share a row of words."""
    rng = random.Random(7)
    masks = [(i, k, ["GroundedSAM2", "SAM2_AMG"][k % 2], *(rng.choice([0, 1, 2, 8]) for _ in range(2)), rng.randint(6, 22), rng.randint(6, 22)) for i in range(3) for k in range(24)]
    px = pixels(spark, masks)
    cells = {(i, k): {(x, y) for x in range(x0, x0 + w) for y in range(y0, y0 + h)} for i, k, _, x0, y0, w, h in masks}
    close = {(i, a, b) for i, a in cells for j, b in cells if i == j and a % 2 and not b % 2 and len(cells[i, a] & cells[i, b]) >= 0.7 * len(cells[i, a] | cells[i, b])}
    ext = P.mask_bounds(px)
    left = {(r.image_id, r.a, r.b) for r in P.threshold_pairs(ext.where("segmentor = 'SAM2_AMG'"), ext.where("segmentor = 'GroundedSAM2'")).collect()}
    assert close and close <= left and len(left) < 0.7 * 3 * 12 * 12
    objects = px.select("image_id", "obj_idx", "segmentor").distinct()
    got = {(r.image_id, r.obj_idx) for r in P.dedup_masks(objects, px).collect()}
    assert got == set(cells) - {(i, a) for i, a, _ in close}


def test_nearest_breaks_ties_by_index(spark):
    rows = [(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (0, 2, 0.0, 1.0), (0, 3, -1.0, 0.0), (1, 0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "image_id long, obj_idx long, ux double, uy double")
    got = P.nearest(df, Config(neighbours=2)).collect()
    assert [r.b for r in sorted((r for r in got if r.a == 0), key=lambda r: r["rank"])] == [1, 2]
    assert max(sum(r.a == k for r in got) for k in range(4)) <= 2 and all(r.image_id == 0 for r in got)


@pytest.mark.parametrize("shape", ["even", "clumps", "line", "same place", "few"])
def test_nearest_of_many_objects(spark, shape):
    """Images too large for all pairs, against all pairs; ties and far outliers too."""
    rng = random.Random(shape)
    place = {
        "even": lambda k: (rng.randint(0, 500), rng.randint(0, 500)), "clumps": lambda k: (rng.choice([0, 3, 9000]) + rng.random(), rng.choice([0, 700]) + rng.random()),
        "line": lambda k: (float(k), 7.0), "same place": lambda k: (1.0, 1.0), "few": lambda k: (rng.random(), rng.random()),
    }[shape]
    rows = [(i, k, *map(float, place(k))) for i, n in ((0, 12 if shape == "few" else 300), (1, 5), (2, 1)) for k in range(n)]
    got = P.nearest(spark.createDataFrame(rows, "image_id long, obj_idx long, ux double, uy double"), Config(neighbours=8))
    want = set()
    for i, a, x, y in rows:
        others = sorted(((u - x) ** 2 + (v - y) ** 2, b) for j, b, u, v in rows if j == i and b != a)
        want |= {(i, a, b, r) for r, (_, b) in enumerate(others[:8], 1)}
    assert {(r.image_id, r.a, r.b, r["rank"]) for r in got.collect()} == want


def test_crowd_at_one_place_is_no_group_of_pairs(spark):
    """100,000 objects on one centroid and some around it, against all pairs by place."""
    n, k = 100_000, 8
    rng = random.Random(9)
    around = [(n + i, 5.0 + rng.choice([-1, 0, 1]) * 10.0 ** -rng.randint(0, 3), 5.0 + rng.random() * 10.0 ** -rng.randint(0, 3)) for i in range(200)]
    crowd = spark.range(n).selectExpr("0L AS image_id", "id AS obj_idx", "5.0D AS ux", "5.0D AS uy")
    df = crowd.unionByName(spark.createDataFrame([(0, *r) for r in around], "image_id long, obj_idx long, ux double, uy double"))
    got = {}
    for r in P.nearest(df).select("a", "b", "rank").toArrow().to_pylist():
        got.setdefault(r["a"], []).append((r["rank"], r["b"]))
    assert len(got) == n + 200
    first = [(i, 5.0, 5.0) for i in range(k + 1)]
    for a in [0, 4, 8, 9, 5000, n - 1, *(r[0] for r in around)]:
        x, y = next(((x, y) for i, x, y in around if i == a), (5.0, 5.0))
        others = sorted(((u - x) ** 2 + (v - y) ** 2, b) for b, u, v in first + around if b != a)
        assert sorted(got[a]) == [(i, b) for i, (_, b) in enumerate(others[:k], 1)]


def test_label_match_takes_the_first_object(spark):
    objects = spark.createDataFrame([(0, 0, "obj_0", "red cup", "c0"), (0, 1, "obj_1", "cup", ""), (0, 2, "obj_2", "table", None)], "image_id long, obj_idx long, id string, label string, caption string")
    rows = [
        (0, 0, " CUP ", "on", "Table", None, None, 0.123456), (0, 1, "sofa", "on", "table", None, "obj_2", 1.0), (0, 2, "x", "on", "lamp", "obj_1", "obj_9", 1.0),
        (0, 3, "", "on", "", "obj_2", None, 1.0), (0, 4, "big table", None, "cup", "nope", "obj_1", 1.0),
    ]
    t = spark.createDataFrame(rows, "image_id long, seq long, sub string, pred string, obj string, sub_id string, obj_id string, score double")
    got = {r.seq: r for r in R.attach(t, objects).collect()}
    assert set(got) == {0, 2, 3, 4}
    assert (got[0].source_id, got[0].target_id, got[0].target_label, got[0].target_caption, got[0].score) == ("obj_0", "obj_2", "table", "", 0.1235)
    assert (got[2].source_id, got[2].target_id, got[2].target_label) == ("obj_1", "external_lamp", "lamp")
    assert got[3].target_id == "external_unknown" and (got[4].source_id, got[4].predicate, got[4].target_id) == ("obj_2", "related_to", "obj_1")
    c = R.attach_counts(t, objects).first()
    assert (c.input_triplets, c.attached, c.subject_id_matched, c.subject_label_matched, c.unmatched_subjects) == (5, 4, 2, 2, 1)
    assert (c.target_id_matched, c.target_label_matched, c.external_targets) == (1, 1, 2)
    node_ids = {r.id for r in objects.collect()}
    assert all(r.target_id in node_ids or r.target_id.startswith("external_") for r in got.values())


@pytest.mark.parametrize("meet", [R.MEET, 0])
def test_labels_by_index_equal_all_pairs(spark, monkeypatch, meet):
    """Needles and labels inside each other, of one image with most rows and of small ones;
    without pairs (0), every image goes by the index."""
    monkeypatch.setattr(R, "MEET", meet)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab c\u00e9") for _ in range(n))
    labels = [(i, k, text(rng.randint(0, 9)).upper() if k % 9 else ["", None][k % 2]) for i, n in ((0, 400), (1, 5), (2, 1)) for k in range(n)]
    labels += [(3, k, "obj" + text(4)) for k in range(3)]
    needles = sorted({(i, text(rng.randint(1, 12))) for i, n in ((0, 500), (1, 6), (2, 2), (4, 3)) for _ in range(n)})
    o = spark.createDataFrame(labels, "image_id long, obj_idx long, label string")
    got = R.first_by_label(spark.createDataFrame(needles, "image_id long, needle string"), o).collect()
    want = {}
    for i, w in needles:
        hits = [k for j, k, t in labels if j == i and t is not None and (w in t.lower() or t.lower() in w)]
        if hits:
            want[i, w] = min(hits)
    assert len(got) == len(want) and {(r.image_id, r.needle): r.idx for r in got} == want


def test_caption_of_the_first_labeller_that_has_one(spark):
    objects = spark.createDataFrame(
        [(0, 0, "a", "x", "own", "tag", "florence"), (0, 1, "b", "y", "", "tag", "florence"), (0, 2, "c", "z", None, "", "florence"), (0, 3, "d", "w", "", None, "")],
        "image_id long, obj_idx long, id string, label string, caption string, rampp_caption string, florence2_caption string",
    )
    t = spark.createDataFrame([(0, k, "x", "on", "q", "a", i, 1.0) for k, i in enumerate("abcd")], "image_id long, seq long, sub string, pred string, obj string, sub_id string, obj_id string, score double")
    assert [r.target_caption for r in R.attach(t, objects).orderBy("seq").collect()] == ["own", "tag", "florence", ""]


def test_strict_triplet_check_fails(spark):
    counts = spark.createDataFrame([(7, 2)], "image_id long, n_objects long")
    none = spark.createDataFrame([], "image_id long")
    assert R.missing_triplets(counts, none).count() == 1
    with pytest.raises(Exception, match="no triplets for image 7"):
        R.missing_triplets(counts, none, strict=True).collect()


def test_score_of_equal_and_missing_metrics(spark):
    rows = [("a", 1.0, None, 3, 0.5, 0.1), ("b", 1.0, 0.5, 5, 0.9, None), ("c", 1.0, 0.7, 4, 0.7, 0.3)]
    df = spark.createDataFrame(rows, "model string, avg_per_image double, conf_mean double, n_unique_labels long, mask_match_rate double, depth_std_mean double")
    got = {r.model: r.score for r in E.composite_score(df).collect()}
    assert got["a"] == pytest.approx(0.15 * 0.5 + 0 + 0 + 0 + 0.15 * 1)
    assert got["b"] == pytest.approx(0.15 * 0.5 + 0 + 0.2 + 0.3 + 0.15 * 1)
    assert got["c"] == pytest.approx(0.15 * 0.5 + 0.2 + 0.1 + 0.15 + 0)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_nested_loops_or_row_functions(spark):
    from __spark_entry__ import QUERIES

    for name in ("jn02_mask_iou", "jn03_box_iou", "jn04_dedup", "jn07_nearest", "jn08_semantic_gate", "ag09_region_stats", "sc10_box_relations", "jn10_attach"):
        plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "EvalPython" not in plan, name


def test_rank_limit_is_pushed_below_the_window(spark):
    from __spark_entry__ import QUERIES

    assert "WindowGroupLimit" in plan_of(QUERIES["jn07_nearest"](spark, "/root/testdata/sf0.001"))
