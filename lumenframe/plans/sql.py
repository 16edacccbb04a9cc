"""SQL forms of the input tables and of shared steps, composed into single statements.

They are written from the definitions, apart from the DataFrame operators, so that each
checks the other."""

from __future__ import annotations

import re

from ..sources.fixtures import CATEGORIES

#: Fixed values, written a second time so that a slip on one side shows.
GENERIC_TAGS = (
    "object", "objects", "thing", "things", "item", "items", "entity", "entities", "scene", "image", "photo", "picture",
)
STOPWORDS = (
    "a", "an", "the", "some", "one", "two", "three", "with", "on", "of", "in", "at", "by", "and", "or", "from", "to", "for", "as", "up", "out", "into",
    "over", "under", "about", "around", "is", "are", "was", "were", "be", "been", "being", "has", "have", "can", "may", "will", "appears", "seems",
    "showing", "shows", "shown", "this", "that", "these", "those", "it", "its", "there", "their", "image", "photo", "picture", "view", "close", "shot",
    "side", "top", "front", "back", "left", "right", "center", "middle", "red", "blue", "green", "yellow", "white", "black", "brown", "grey", "gray",
    "orange", "purple", "pink", "dark", "light", "bright", "large", "small", "big", "little", "tiny", "tall", "short", "long", "old", "new", "open",
    "closed", "empty", "full", "flat", "round", "square", "wooden", "metal", "plastic", "glass", "stone", "brick", "single", "double", "multiple",
    "various", "different", "same", "very", "quite", "just", "also", "well",
)
PHRASES = (
    "on top of", "under", "next to", "in front of", "behind", "inside", "hanging from", "leaning against", "holding", "wearing", "using", "near",
)
RELATION_RULES = (
    (("on top of", "resting on", "placed on", "sitting on", "standing on", "lying on"), "on"),
    (("under", "below", "beneath"), "under"),
    (("next to", "beside", "adjacent", "alongside"), "is_next_to"),
    (("in front of", "in front"), "in_front_of"),
    (("behind", "in back of"), "behind"),
    (("inside", "within", "contained in", "in the"), "inside_of"),
    (("hanging from", "suspended from"), "hangs_from"),
    (("leaning on", "leaning against"), "leans_on"),
    (("at", "located at"), "at"),
    (("holding", "carrying", "gripping", "grabbing"), "holds"),
    (("wearing", "dressed in"), "wears"),
    (("riding", "mounted on"), "rides"),
    (("eating", "consuming"), "eats"),
    (("drinking",), "drinks"),
    (("reading",), "reads"),
    (("using", "operating"), "uses"),
    (("looking at", "gazing at"), "looks_at"),
    (("talking on", "speaking on"), "talks_on_phone"),
    (("playing",), "plays"),
    (("kicking",), "kicks"),
    (("catching",), "catches"),
    (("cutting",), "cuts"),
)

_words = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"


def relation_case(col: str) -> str:
    rules = (f"WHEN {' OR '.join(f'contains({col}, {chr(39)}{p}{chr(39)})' for p in phrases)} THEN '{pred}'" for phrases, pred in RELATION_RULES)
    return "CASE " + " ".join(rules) + " END"


def noun(col: str) -> str:
    strip = "regexp_replace(regexp_replace(w, '^[.,;:!?\"''()]+', ''), '[.,;:!?\"''()]+$', '')"
    words = f"list_transform(string_split_regex(lower({col}), '\\s+'), lambda w: {strip})"
    keep = f"list_filter({words}, lambda w: regexp_matches(w, '^\\p{{L}}{{3,}}$') AND w NOT IN {_words(STOPWORDS)})"
    return f"coalesce({keep}[1], 'object')"


GENERIC = _words(GENERIC_TAGS)

STEPS = {
    "frames": """SELECT o_orderkey::BIGINT AS image_id, (640 + (o_custkey % 8) * 320)::BIGINT AS width,
        (480 + (o_custkey % 5) * 240)::BIGINT AS height, (o_orderkey % 10)::BIGINT AS camera_id,
        CASE WHEN o_orderkey % 5000 = 0 THEN 12 ELSE 1 END AS s FROM orders""",
    "sized": "SELECT image_id, (64 * s)::BIGINT AS gw, (64 * s)::BIGINT AS gh FROM frames",
    "base_det": """SELECT l_orderkey::BIGINT AS image_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS obj_idx,
        CASE l_returnflag WHEN 'A' THEN 'GroundedSAM2' WHEN 'N' THEN 'SAM2_AMG' ELSE 'SAM3' END AS segmentor,
        (l_partkey % 8) * 6 * s AS x, (l_suppkey % 6) * 6 * s AS y, (4 + l_quantity::BIGINT % 13) * s AS w, (4 + l_partkey % 11) * s AS h,
        floor(l_extendedprice / 10)::BIGINT AS z_mm, 100 - round(l_discount * 100)::BIGINT * 5 AS conf_pct, l_partkey::BIGINT AS part_id, s
        FROM (SELECT *, CASE WHEN l_orderkey % 5000 = 0 THEN 12 ELSE 1 END AS s FROM lineitem)""",
    "detections": """SELECT image_id, obj_idx, segmentor, x, y, w, h, z_mm, conf_pct, part_id FROM base_det UNION ALL
        SELECT image_id, obj_idx + 100, 'SAM2_AMG', x, y, w + s, h, z_mm, conf_pct, part_id FROM base_det
        WHERE segmentor = 'GroundedSAM2' AND part_id % 3 = 0""",
    "boxes": "SELECT *, x AS x1, y AS y1, x + w AS x2, y + h AS y2, x + w / 2.0 AS ux, y + h / 2.0 AS uy FROM detections",
    "mask_px": """SELECT * FROM (SELECT image_id, obj_idx, segmentor, z_mm, px, unnest(range(y, y + h)) AS py
        FROM (SELECT *, unnest(range(x, x + w)) AS px FROM detections))
        WHERE (px * 7 + py * 13 + image_id) % 11 <> 0""",
    "box_px": """SELECT image_id, obj_idx, px, unnest(range(y, y + h)) AS py FROM (SELECT *, unnest(range(x, x + w)) AS px FROM detections)""",
    "depth_px": """SELECT g.image_id, g.px, g.py, CASE WHEN (g.px + g.py * 29 + g.image_id) % 211 <> 0 THEN
        coalesce(c.z, 9000) + (g.px * 11 + g.py * 17 + g.image_id) % 97 + CASE WHEN (g.px * 5 + g.py * 3 + g.image_id) % 41 = 0 THEN 4000 ELSE 0 END END AS depth_mm
        FROM (SELECT image_id, px, unnest(range(gh)) AS py FROM (SELECT *, unnest(range(gw)) AS px FROM sized)) g
        LEFT JOIN (SELECT image_id, px, py, min(z_mm) AS z FROM mask_px GROUP BY ALL) c USING (image_id, px, py)""",
    "cameras": """SELECT s_suppkey::BIGINT AS camera_id, CASE WHEN s_suppkey % 3 <> 0 THEN (600 + 7 * s_suppkey)::DOUBLE END AS fx,
        CASE WHEN s_suppkey % 3 <> 0 THEN (602 + 7 * s_suppkey)::DOUBLE END AS fy, CASE WHEN s_suppkey % 3 = 1 THEN 320.0::DOUBLE END AS cx,
        CASE WHEN s_suppkey % 3 = 1 THEN 240.0::DOUBLE END AS cy, -(s_suppkey % 30)::DOUBLE / 100 AS k1, (s_suppkey % 7)::DOUBLE / 100 AS k2 FROM supplier""",
    "k": """SELECT f.image_id, f.width, f.height, f.camera_id,
        CASE WHEN c.cx IS NOT NULL AND c.fx IS NOT NULL THEN 'calibration' WHEN c.fx IS NOT NULL THEN 'explicit' ELSE 'fov' END AS k_source,
        coalesce(c.fx, f.width / 2.0::DOUBLE / tan(radians(60.0::DOUBLE) / 2)) AS fx, coalesce(c.fy, c.fx, f.width / 2.0::DOUBLE / tan(radians(60.0::DOUBLE) / 2)) AS fy,
        coalesce(c.cx, f.width / 2.0::DOUBLE) AS cx, coalesce(c.cy, f.height / 2.0::DOUBLE) AS cy, c.k1, c.k2
        FROM frames f LEFT JOIN cameras c USING (camera_id)""",
    "captions": f"""SELECT p_partkey::BIGINT AS part_id, phrase, 'a ' || p_name || ' ' || phrase || ' a ' || lower(p_type) || ' table' AS caption,
        string_split(p_name, ' ')[-1] AS last_word, lower(p_type) AS type_label
        FROM (SELECT *, [{', '.join(f"'{p}'" for p in PHRASES)}][(p_partkey % 12 + 1)::INT] AS phrase FROM part)""",
    "label_candidates": f"""SELECT image_id, obj_idx, segmentor, x, y, w, h, z_mm, part_id, conf_pct / 100.0::DOUBLE AS conf,
        CASE WHEN segmentor <> 'GroundedSAM2' OR part_id % 5 = 0 THEN 'object' ELSE last_word END AS detector_label,
        CASE WHEN part_id % 4 = 0 THEN 'object' ELSE {noun('caption')} END AS caption_label, caption,
        CASE WHEN part_id % 6 = 0 THEN 'object' ELSE type_label END AS tag_label FROM detections JOIN captions USING (part_id)""",
    "labelled": """SELECT image_id, obj_idx, segmentor, x, y, w, h, z_mm, part_id, CASE segmentor WHEN 'SAM3' THEN 'sam3_obj_' || obj_idx ELSE 'obj_' || obj_idx || '_GroundedSAM2' END AS id,
        detector_label AS grounded_label, conf AS grounded_conf,
        CASE WHEN detector_label <> 'object' THEN detector_label WHEN caption_label <> 'object' THEN caption_label WHEN tag_label <> 'object' THEN tag_label ELSE 'object' END AS label,
        CASE WHEN detector_label <> 'object' THEN conf WHEN caption_label <> 'object' THEN 0.75 WHEN tag_label <> 'object' THEN 0.7 ELSE 0.0 END AS label_conf,
        CASE WHEN detector_label <> 'object' THEN detector_label WHEN caption_label <> 'object' THEN caption WHEN tag_label <> 'object' THEN tag_label ELSE coalesce(nullif(caption, ''), 'object') END AS caption,
        CASE WHEN detector_label <> 'object' THEN 'detector' WHEN caption_label <> 'object' THEN 'caption' WHEN tag_label <> 'object' THEN 'tags' ELSE 'fallback' END AS source_model,
        caption_label AS florence2_label, caption AS florence2_caption,
        CASE WHEN detector_label = 'object' AND caption_label = 'object' THEN tag_label ELSE 'object' END AS rampp_label FROM label_candidates""",
    "triplets": f"""SELECT d.image_id, d.obj_idx AS seq, c.last_word AS sub, {relation_case('c.caption')} AS pred, coalesce(n.last_word, 'unknown') AS obj,
        CASE WHEN d.part_id % 8 <> 0 THEN CASE d.segmentor WHEN 'SAM3' THEN 'sam3_obj_' || d.obj_idx ELSE 'obj_' || d.obj_idx || '_GroundedSAM2' END END AS sub_id,
        CASE WHEN d.part_id % 12 <> 0 THEN CASE d.segmentor WHEN 'SAM3' THEN 'sam3_obj_' || (d.obj_idx + 1) ELSE 'obj_' || (d.obj_idx + 1) || '_GroundedSAM2' END END AS obj_id, d.conf_pct / 100.0::DOUBLE AS score
        FROM detections d JOIN captions c USING (part_id) LEFT JOIN captions n ON n.part_id = d.part_id + 1 WHERE d.part_id % 4 = 0""",
    "series": """SELECT user_id::BIGINT AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no,
        round(value * 100)::BIGINT AS depth_cm, event_id::BIGINT AS event_id, ts FROM events""",
    "runs": """SELECT event_type AS model, user_id::BIGINT AS image_id, event_id::BIGINT AS det_id, CASE WHEN event_id % 11 <> 0 THEN value / 500 END AS conf,
        'label_' || (event_id % 37) AS label, event_id % 7 <> 0 AS mask_matched, CASE WHEN event_id % 13 <> 0 THEN (event_id % 100) / 50.0::DOUBLE END AS depth_std FROM events""",
    "run_images": "SELECT DISTINCT m.model, i.image_id FROM (SELECT DISTINCT model FROM runs) m, (SELECT DISTINCT image_id FROM runs) i",
    "categories": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in CATEGORIES) + ") AS c(id, name)",
    "knn": """SELECT * FROM (SELECT a.image_id, a.obj_idx AS a, b.obj_idx AS b, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2,
        b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, b.ux - a.ux AS dx, b.uy - a.uy AS dy, a.z_mm AS az, b.z_mm AS bz,
        row_number() OVER (PARTITION BY a.image_id, a.obj_idx ORDER BY (b.ux - a.ux) ** 2 + (b.uy - a.uy) ** 2, b.obj_idx) AS rank
        FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.obj_idx <> b.obj_idx) WHERE rank <= 8""",
    "centred": """SELECT b.* REPLACE (coalesce(mx, ux) AS ux, coalesce(my, uy) AS uy), mx IS NOT NULL AS masked FROM boxes b LEFT JOIN (
        SELECT image_id, obj_idx, round(sum(px) / count(*)::DOUBLE, 6) AS mx, round(sum(py) / count(*)::DOUBLE, 6) AS my FROM mask_px
        JOIN detections USING (image_id, obj_idx) WHERE part_id % 7 <> 0 GROUP BY ALL) USING (image_id, obj_idx)""",
    "centred_knn": """SELECT * FROM (SELECT a.image_id, a.obj_idx AS a, b.obj_idx AS b, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2,
        b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, b.ux - a.ux AS dx, b.uy - a.uy AS dy, a.z_mm AS az, b.z_mm AS bz, a.masked AS am, b.masked AS bm,
        row_number() OVER (PARTITION BY a.image_id, a.obj_idx ORDER BY (b.ux - a.ux) * (b.ux - a.ux) + (b.uy - a.uy) * (b.uy - a.uy), b.obj_idx) AS rank
        FROM centred a JOIN centred b ON a.image_id = b.image_id AND a.obj_idx <> b.obj_idx) WHERE rank <= 8""",
    "box_pairs": """SELECT *, iw * ih / (a_area + b_area - iw * ih + 1e-8::DOUBLE) AS iou FROM (
        SELECT a.image_id, a.obj_idx AS a, b.obj_idx AS b, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS iw, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS ih,
        a.w * a.h AS a_area, b.w * b.h AS b_area FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.obj_idx <> b.obj_idx) WHERE iw > 0 AND ih > 0""",
    "mask_area": "SELECT image_id, obj_idx, any_value(segmentor) AS segmentor, count(*) AS area, min(px) AS x_min, max(px) AS x_max, min(py) AS y_min, max(py) AS y_max FROM mask_px GROUP BY image_id, obj_idx",
    "mask_pairs": """SELECT i.*, m.area + n.area - i.inter AS joint, i.inter / (m.area + n.area - i.inter)::DOUBLE AS iou, m.segmentor AS a_seg, n.segmentor AS b_seg FROM (
        SELECT a.image_id, a.obj_idx AS a, b.obj_idx AS b, count(*) AS inter FROM mask_px a JOIN mask_px b USING (image_id, px, py) WHERE a.obj_idx <> b.obj_idx GROUP BY ALL) i
        JOIN mask_area m ON m.image_id = i.image_id AND m.obj_idx = i.a JOIN mask_area n ON n.image_id = i.image_id AND n.obj_idx = i.b""",
    "dedup": """SELECT image_id, obj_idx, 'primary' AS origin FROM mask_area WHERE segmentor = 'GroundedSAM2' UNION ALL
        SELECT image_id, obj_idx, 'survivor' FROM mask_area c WHERE segmentor = 'SAM2_AMG' AND NOT EXISTS (
        SELECT 1 FROM mask_pairs p WHERE p.image_id = c.image_id AND p.a = c.obj_idx AND p.b_seg = 'GroundedSAM2' AND p.iou >= 0.7)""",
    "kernel": """SELECT *, CASE WHEN area > 4 * k0 * k0 THEN k0 ELSE 0 END AS k FROM (SELECT *, CASE WHEN side < 15 THEN 0 WHEN side < 40 THEN 1 WHEN side < 80 THEN 2 WHEN side < 150 THEN 3 ELSE 5 END AS k0
        FROM (SELECT *, least(x_max - x_min, y_max - y_min) + 1 AS side FROM mask_area))""",
    "hits": """SELECT m.image_id, m.obj_idx, m.px, m.py, count(n.px) AS n,
        (least(m.px + k - 1 - k // 2, gw - 1) - greatest(m.px - k // 2, 0) + 1) * (least(m.py + k - 1 - k // 2, gh - 1) - greatest(m.py - k // 2, 0) + 1) AS want
        FROM (SELECT p.*, k.k, s.gw, s.gh, o.dx, q.dy FROM mask_px p JOIN kernel k USING (image_id, obj_idx) JOIN sized s USING (image_id),
              (SELECT unnest(range(-2, 3)) AS dx) o, (SELECT unnest(range(-2, 3)) AS dy) q
              WHERE k.k > 1 AND o.dx BETWEEN -(k.k // 2) AND k.k - 1 - k.k // 2 AND q.dy BETWEEN -(k.k // 2) AND k.k - 1 - k.k // 2) m
        LEFT JOIN mask_px n ON n.image_id = m.image_id AND n.obj_idx = m.obj_idx AND n.px = m.px + m.dx AND n.py = m.py + m.dy
        GROUP BY m.image_id, m.obj_idx, m.px, m.py, k, gw, gh""",
    "eroded": """SELECT p.image_id, p.obj_idx, p.px, p.py FROM mask_px p JOIN kernel k USING (image_id, obj_idx) WHERE k.k <= 1
        OR (p.image_id, p.obj_idx) NOT IN (SELECT (image_id, obj_idx) FROM hits WHERE n = want)
        UNION ALL SELECT image_id, obj_idx, px, py FROM hits WHERE n = want""",
    "widened": """SELECT DISTINCT image_id, obj_idx, px + dx AS px, py FROM eroded JOIN sized USING (image_id), (SELECT unnest(range(-2, 3)) AS dx) o WHERE px + dx BETWEEN 0 AND gw - 1""",
    "dilated": """SELECT DISTINCT image_id, obj_idx, px, py + dy AS py FROM widened JOIN sized USING (image_id), (SELECT unnest(range(-2, 3)) AS dy) q WHERE py + dy BETWEEN 0 AND gh - 1""",
    "ring": "SELECT * FROM dilated ANTI JOIN eroded USING (image_id, obj_idx, px, py)",
    "seen": "SELECT e.*, d.depth_mm FROM eroded e JOIN depth_px d USING (image_id, px, py) WHERE d.depth_mm IS NOT NULL",
    "clip_of": """SELECT image_id, obj_idx, count(*) AS n, sum(depth_mm)::BIGINT AS s, sum(depth_mm * depth_mm)::BIGINT AS q FROM seen GROUP BY ALL""",
    "inlier": """SELECT s.*, NOT (c.n >= 10 AND sqrt((c.n * c.q - c.s * c.s)::DOUBLE) / c.n > 1e-3) OR abs(c.n * s.depth_mm - c.s) < 2 * sqrt((c.n * c.q - c.s * c.s)::DOUBLE) AS ok
        FROM seen s JOIN clip_of c USING (image_id, obj_idx)""",
    "clipped": """SELECT image_id, obj_idx, px, py, depth_mm FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY image_id, obj_idx) AS m FROM inlier) WHERE ok OR m < 5""",
    "stats": """SELECT image_id, obj_idx, min(depth_mm) AS lo, max(depth_mm) AS hi, sum(depth_mm)::BIGINT AS s, sum(depth_mm * depth_mm)::BIGINT AS q, count(*) AS n, median(depth_mm) AS med
        FROM clipped GROUP BY ALL""",
    "near": """SELECT c.*, wx, wy, round_even((c.px - wx) * (c.px - wx) + (c.py - wy) * (c.py - wy), 6) AS d2 FROM clipped c JOIN (
        SELECT image_id, obj_idx, round_even(sum(px / (depth_mm / 1000.0::DOUBLE + 1e-6::DOUBLE)) / sum(1 / (depth_mm / 1000.0::DOUBLE + 1e-6::DOUBLE)), 6) AS wx,
        round_even(sum(py / (depth_mm / 1000.0::DOUBLE + 1e-6::DOUBLE)) / sum(1 / (depth_mm / 1000.0::DOUBLE + 1e-6::DOUBLE)), 6) AS wy FROM clipped GROUP BY ALL) USING (image_id, obj_idx)""",
    "snapped": "SELECT image_id, obj_idx, px AS u, py AS v FROM (SELECT *, row_number() OVER (PARTITION BY image_id, obj_idx ORDER BY d2, py, px) AS r FROM near) WHERE r = 1",
    "pixels_of": "SELECT image_id, obj_idx, count(*) AS num_pixels FROM eroded GROUP BY ALL",
    "circle": "SELECT n.* FROM near n JOIN pixels_of USING (image_id, obj_idx) WHERE d2 <= num_pixels * 0.5::DOUBLE / pi()",
    "bins": """SELECT *, CASE WHEN lo0 = hi0 THEN lo0 - 500 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 500 ELSE hi0 END AS hi, greatest(10, least(100, z_pixels // 5)) AS bins
        FROM (SELECT image_id, obj_idx, min(depth_mm) AS lo0, max(depth_mm) AS hi0, count(*) AS z_pixels FROM circle GROUP BY ALL)""",
    "mode": """SELECT image_id, obj_idx, z_pixels, lo + (2 * b + 1) * (hi - lo) / (2.0::DOUBLE * bins) AS z_mm FROM (
        SELECT *, row_number() OVER (PARTITION BY image_id, obj_idx ORDER BY c DESC, b) AS r FROM (
        SELECT image_id, obj_idx, z_pixels, lo, hi, bins, least(bins - 1, (depth_mm - lo) * bins // (hi - lo)) AS b, count(*) AS c FROM circle JOIN bins USING (image_id, obj_idx) GROUP BY ALL)) WHERE r = 1""",
    "ring_of": "SELECT image_id, obj_idx, sum(depth_mm) / count(*)::DOUBLE AS ring_mm FROM ring JOIN depth_px USING (image_id, px, py) WHERE depth_mm IS NOT NULL GROUP BY ALL",
    "region": """SELECT o.image_id, o.obj_idx, coalesce(floor((s.lo) * 10 + 0.500001::DOUBLE) / 10000, 0) AS d_min, coalesce(floor((s.hi) * 10 + 0.500001::DOUBLE) / 10000, 0) AS d_max,
        coalesce(floor((s.s / s.n::DOUBLE) * 10 + 0.500001::DOUBLE) / 10000, 0) AS d_mean, coalesce(floor((s.med) * 10 + 0.500001::DOUBLE) / 10000, 0) AS d_median,
        coalesce(floor((sqrt((s.n * s.q - s.s * s.s)::DOUBLE) / s.n) * 10 + 0.500001::DOUBLE) / 10000, 0) AS d_std,
        CASE WHEN s.n IS NOT NULL THEN p.num_pixels ELSE 0 END AS num_pixels,
        CASE WHEN s.n IS NOT NULL THEN floor(coalesce(m.z_mm, s.med) * 10 + 0.500001::DOUBLE) / 10000 END AS z_val,
        CASE WHEN s.n IS NOT NULL THEN coalesce(m.z_pixels, s.n) ELSE 0 END AS z_val_pixels,
        coalesce(abs(s.s / s.n::DOUBLE - r.ring_mm) < 150, false) AS transparent, coalesce(floor((abs(s.s / s.n::DOUBLE - r.ring_mm)) * 10 + 0.500001::DOUBLE) / 10000, 0) AS separation,
        coalesce(u, gw // 2) AS u, coalesce(v, gh // 2) AS v
        FROM (SELECT DISTINCT image_id, obj_idx FROM detections) o JOIN sized USING (image_id)
        LEFT JOIN pixels_of p USING (image_id, obj_idx) LEFT JOIN stats s USING (image_id, obj_idx) LEFT JOIN snapped USING (image_id, obj_idx)
        LEFT JOIN mode m USING (image_id, obj_idx) LEFT JOIN ring_of r USING (image_id, obj_idx)""",
    "wanted": """SELECT *, lower(trim(sub)) AS ns, lower(trim(obj)) AS nt FROM triplets""",
    "by_label": """SELECT w.image_id, w.needle, min(l.obj_idx) AS idx FROM (SELECT DISTINCT image_id, ns AS needle FROM wanted UNION SELECT DISTINCT image_id, nt FROM wanted) w
        JOIN labelled l ON l.image_id = w.image_id AND w.needle <> '' AND (contains(lower(l.label), w.needle) OR contains(w.needle, lower(l.label))) GROUP BY ALL""",
    "resolved": """SELECT t.*, si.obj_idx AS s_id, ti.obj_idx AS t_id, sl.idx AS s_lab, tl.idx AS t_lab, coalesce(si.obj_idx, sl.idx) AS s_idx, coalesce(ti.obj_idx, tl.idx) AS t_idx FROM wanted t
        LEFT JOIN labelled si ON si.image_id = t.image_id AND si.id = t.sub_id LEFT JOIN labelled ti ON ti.image_id = t.image_id AND ti.id = t.obj_id
        LEFT JOIN by_label sl ON sl.image_id = t.image_id AND sl.needle = t.ns LEFT JOIN by_label tl ON tl.image_id = t.image_id AND tl.needle = t.nt""",
    "attached": """SELECT r.image_id, r.seq, s.id AS source_id, coalesce(r.pred, 'related_to') AS predicate, coalesce(t.id, 'external_' || coalesce(nullif(r.nt, ''), 'unknown')) AS target_id,
        coalesce(t.label, coalesce(nullif(r.nt, ''), 'unknown')) AS target_label, coalesce(t.caption, '') AS target_caption, round_even(r.score, 4) AS score
        FROM resolved r JOIN labelled s ON s.image_id = r.image_id AND s.obj_idx = r.s_idx LEFT JOIN labelled t ON t.image_id = r.image_id AND t.obj_idx = r.t_idx""",
    "report": """SELECT * FROM (SELECT model, count(*) AS n_images, sum(n)::BIGINT AS n_total_detections, round_even(sum(n) / count(*)::DOUBLE, 1) AS avg_per_image, min(n) AS min_per_image, max(n) AS max_per_image
          FROM (SELECT i.model, i.image_id, count(r.det_id) AS n FROM run_images i LEFT JOIN runs r USING (model, image_id) GROUP BY ALL) GROUP BY model)
        LEFT JOIN (SELECT model, round_even(avg(conf), 4) AS conf_mean, round_even(median(conf), 4) AS conf_median, round_even(min(conf), 4) AS conf_min, round_even(max(conf), 4) AS conf_max FROM runs GROUP BY model) USING (model)
        LEFT JOIN (SELECT model, count(*) AS n_unique_labels, list_slice(list_sort(list(label)), 1, 15) AS top_labels FROM (SELECT DISTINCT model, lower(trim(label)) AS label FROM runs WHERE label <> '') GROUP BY model) USING (model)
        LEFT JOIN (SELECT model, count(*) AS n_scene_objects, count(*) FILTER (mask_matched) AS mask_matched, count(*) FILTER (NOT mask_matched) AS mask_unmatched,
          count(*) FILTER (mask_matched) / count(*)::DOUBLE AS mask_match_rate, round_even(avg(depth_std), 4) AS depth_std_mean, round_even(median(depth_std), 4) AS depth_std_median FROM runs GROUP BY model) USING (model)""",
}


def compose(body: str) -> str:
    """body with the steps that it names after FROM or JOIN, and theirs, before it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in need and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(STEPS[name])
                if name not in need:
                    need.append(name)

    visit(body)
    head = ",\n".join(f"{n} AS (\n{STEPS[n]}\n)" for n in need)
    return f"WITH {head}\n{body}" if need else body
