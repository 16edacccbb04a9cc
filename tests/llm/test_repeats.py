"""Suffix arrays, and removal of repeated passages against a plain scan of all windows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lumenframe.llm import entries, repeats, suffixes

from ..oracle import connect

SMALL = "/root/testdata/sf0.001"


def plain(rows, width=100):
    """{(id, n_bytes, spans, kept)} of (id, text) in order of their ids."""
    seen, out = set(), []
    for id_, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        edges = [i for i in range(len(raw) + 1) if (gone[i - 1] if i else 0) != (gone[i] if i < len(raw) else 0)]
        out.append((id_, len(raw), tuple(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r[0], r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_arrays(letters):
    rng = np.random.default_rng(letters)
    for t in range(150):
        text = rng.integers(1, letters + 1, int(rng.integers(1, 90)))
        text = np.append(np.tile(text, 1 + t % 3), 0).astype(np.uint16)
        whole = text.tolist()
        want = sorted(range(len(whole)), key=lambda i: whole[i:])
        sa = suffixes.suffix_array(text)
        assert sa.tolist() == want
        common = suffixes.common_prefixes(text, sa)
        for a, b in zip(want[1:], want, strict=False):
            x, y = whole[a:], whole[b:]
            assert common[a] == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_segments_hold_every_window_once():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 123, 3000).astype(np.uint8)
    raw[500:1200] = 97
    ends = np.array([0, 400, 400, 470, 2000, 3000])
    for m in (32, 64, 100):
        start, n, key, _ = repeats.segments(raw, ends, m, 100)
        windows = [int(w) for s, c in zip(start, n, strict=True) for w in range(s, s + c)]
        assert windows == [w for a, b in zip([0, *ends], ends, strict=False) for w in range(a, b - 99)]
        of = {}
        for s, c, k in zip(start, n, key, strict=True):
            for w in range(s, s + c):
                assert of.setdefault(raw[w : w + 100].tobytes(), k) == k


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefé", k=rng.randint(2, 8))) for _ in range(n))

    passage, line = prose(60), prose(9)[:45]
    out = [None, "", "x" * 99, "x" * 100, "x" * 101, "ab" * 400, "abc" * 300 + "d", passage, prose(5) + passage + prose(5), passage[7:], "中文字" * 80]
    for _ in range(40):  # a phrase shorter than a window in many contexts, and a passage in some
        out.append(prose(20) + line + prose(20) + (passage[: rng.randint(90, 300)] if rng.random() < 0.3 else "") + line + prose(8))
    out += [out[20], out[20], out[21] + out[22], prose(3000) + passage + "q" * 6000 + passage]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_scan(spark, texts, monkeypatch, small):
    if small:  # many hot anchors, several shards
        monkeypatch.setattr(repeats, "MANY", 3)
        monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
        monkeypatch.setattr(repeats, "LONGEST", 50)
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    shuffled = random.Random(1).sample(rows, len(rows))
    docs = spark.createDataFrame([(*r, 1, b"x", "k") for r in shuffled], "doc_id long, text string, row int, seg binary, key string").repartition(5)
    assert rows_of(repeats.remove_repeats(docs)) == plain(rows)


def test_odd_ids(spark, texts):
    """Rows that repeat an id or lack one come after all others: equal rows lose all but one."""
    p = texts[7]
    docs = spark.createDataFrame([(5, p), (5, p), (None, p), (None, None), (9, p + "tail")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, len(r.kept)) for r in repeats.remove_repeats(docs).collect())
    assert got == [(-1, 0), (-1, 0), (5, 0), (5, 0), (9, len(p) + 4)] or sum(k for _, k in got) == len(p.encode()) + 4
    named = spark.createDataFrame([("b", p), ("a", p), (None, None)], "doc_id string, text string")
    got = repeats.remove_repeats(named).collect()
    assert sorted(len(r.kept) for r in got) == [0, 0, len(p.encode())]
    assert repeats.remove_repeats(docs.where("doc_id > 100")).collect() == []
    assert [r.n_bytes for r in repeats.remove_repeats(docs.where("text is null")).collect()] == [0]


def test_query_equals_plain_scan(spark):
    import hashlib

    rows = connect(SMALL).sql("select doc_id, text from documents order by doc_id").fetchall()
    want = {(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in plain(rows)}
    got = entries.op12_suffix_dedup(spark, SMALL)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {tuple(r) for r in got.collect()} == want
