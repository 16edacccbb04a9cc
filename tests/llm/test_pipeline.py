"""The pipeline's stages one by one: on the smallest tables, and on rows with nulls,
repeated ids, equal rows and clashing columns, against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import common, exact_dedup, minhash, packing, toxicity
from lumenframe.llm.common import table
from lumenframe.llm.shingles import shingle_set

SMALL = "/root/testdata/sf0.001"


def _brute_components(texts: dict[int, str], percent: int) -> dict[int, int]:
    """Smallest id reachable by pairs of the given Jaccard similarity of five-word shingles."""
    sets = {i: set(shingle_set(t).tolist()) for i, t in texts.items()}
    smallest = {i: i for i in texts}

    def find(i: int) -> int:
        while smallest[i] != i:
            i = smallest[i]
        return i

    for i, j in combinations(sorted(texts), 2):
        common_ = len(sets[i] & sets[j])
        if common_ and 100 * common_ >= percent * (len(sets[i]) + len(sets[j]) - common_):
            a, b = sorted((find(i), find(j)))
            smallest[b] = a
    return {i: find(i) for i in texts}


def _plain(text: str | None) -> str:
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_stages_work_on_what_is_kept(spark):
    docs = table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    first = corpus_pipeline.toxicity_stage(spark, docs, SMALL)
    assert first.columns == docs.columns
    model = toxicity.fit(docs, table(spark, SMALL, "labels"))
    given = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    kept = {i: t for i, t in given.items() if model.score(t) < toxicity.THRESHOLD}
    assert {r.doc_id for r in first.select("doc_id").collect()} == set(kept)
    groups = defaultdict(list)
    for i, t in kept.items():
        groups[_plain(t)].append((-len(t or ""), i))
    unique = {min(g)[1] for g in groups.values()}
    second = corpus_pipeline.exact_stage(spark, first, SMALL)
    assert {r.doc_id for r in second.select("doc_id").collect()} == unique
    component = _brute_components({i: kept[i] for i in unique}, 80)
    third = corpus_pipeline.near_stage(spark, second, SMALL)
    last = {r.doc_id for r in third.select("doc_id").collect()}
    assert last == {i for i in unique if component[i] == i}
    fourth = {r.doc_id: r.text or "" for r in corpus_pipeline.pii_stage(spark, third, SMALL).select("doc_id", "text").collect()}
    out = corpus_pipeline.run(spark, SMALL).collect()
    whole: dict[int, str] = defaultdict(str)
    load: Counter = Counter()
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    in_bin = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        assert len(r.text) == r["size"]
        whole[r.doc_id] += r.text
        load[r.bin_id] += r["size"]
        in_bin[r.bin_id].append(sources[r.doc_id])
    assert whole == fourth
    assert max(load.values()) <= packing.CAPACITY
    assert all(len(set(s)) == len(s) for s in ([x for x in s if x is not None] for s in in_bin.values()))


def test_near_stage_takes_pairs_of_080(spark):
    rng = np.random.default_rng(5)
    texts = {}
    for k in range(120):  # pairs between 0.76 and 0.90: one run of words differs
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        other = list(words)
        run = 20 + k // 3
        other[100 : 100 + run] = [f"v{x}" for x in rng.integers(0, 10**6, run)]
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(other)
    want = {i for i, c in _brute_components(texts, 80).items() if i == c}
    assert want != {i for i, c in _brute_components(texts, 85).items() if i == c}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SMALL).collect()} == want


#: Columns whose names clash with those that the operators use inside.
ODD = "doc_id long, text string, source string, n_chars long, row_key int, kept boolean, text_sha256 string, score double, part int, _found string, piece int"


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(8)
    a, b, c, d, e, f = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 300)) for _ in range(6))
    rows = [(1, a), (None, a), (None, b), (7, a), (7, c), (7, d), (8, d + " end"), (None, c + " end"), (None, e), (9, f), (9, f), (10, " " + f)]
    rows += [(None, None), (None, None), (11, ""), (12, " \n"), (13, "x " * 40_000), (14, "mail me: jo@x.org or 10.0.0.1")]
    made = [(i, t, None if k % 4 == 0 else "s", None if k % 5 == 0 else len(t or ""), 1, None, "h", 0.5, 2, "f", 3) for k, (i, t) in enumerate(rows)]
    return rows, spark.createDataFrame(made, ODD)


def test_exact_stage_by_row(spark, odd):
    rows, docs = odd
    got = corpus_pipeline.exact_stage(spark, docs, SMALL)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[_plain(t)].append((-len(t or ""), i is None, i or 0, t))
    want = Counter((None if g[1] else g[2], g[3]) for g in map(min, ([(n, no, i, t or "") for n, no, i, t in x] for x in groups.values())))
    assert Counter((i, t or "") for i, t in kept) == want


def test_near_stage_by_row(spark, odd):
    rows, docs = odd
    got = corpus_pipeline.near_stage(spark, docs, SMALL)
    assert got.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in got.collect())
    assert not left - Counter(rows)
    component = _brute_components(dict(enumerate(t for _, t in rows)), 80)
    groups = defaultdict(list)
    for k, row in enumerate(rows):
        groups[component[k]].append(row)
    for members in groups.values():  # one row of each group
        assert sum((left & Counter(members)).values()) == 1 or not _plain(members[0][1])
    assert sum(left.values()) == len(groups)


def test_pii_and_packing_by_row(spark, odd):
    rows, docs = odd
    got = corpus_pipeline.pii_stage(spark, docs, SMALL)
    assert got.columns == docs.columns and got.count() == len(rows)
    assert all(r.n_chars in (None, len(r.text or "")) for r in got.collect())
    assert "n_chars" not in corpus_pipeline.pii_stage(spark, docs.drop("n_chars"), SMALL).columns
    for d in (docs, docs.drop("source")):
        packed = corpus_pipeline.packing_stage(spark, d, SMALL)
        assert packed.columns == ["doc_id", "piece", "start", "size", "bin_id", "bin_at", "bin_free", "text"]
        whole, done = Counter(), packed.orderBy("doc_id", "bin_id").collect()
        for r in done:
            assert len(r.text) == r["size"] and r.start == r.piece * packing.CAPACITY
            whole[r.doc_id] += len(r.text)
        want = Counter()
        for i, t in rows:
            want[i] += len(t or "")
        assert +whole == +want
        short = [(i, t or "") for i, t in rows if len(t or "") <= packing.CAPACITY]
        assert not Counter(short) - Counter((r.doc_id, r.text) for r in done)


def test_toxicity_stage_by_row(spark, odd):
    rows, docs = odd
    got = corpus_pipeline.toxicity_stage(spark, docs, SMALL)
    assert got.columns == docs.columns and not Counter((r.doc_id, r.text) for r in got.collect()) - Counter(rows)


def test_stages_of_nothing_and_of_text_ids(spark, odd):
    docs = odd[1]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SMALL)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        assert stage(spark, named, SMALL).count() == stage(spark, docs, SMALL).count()
    packed = corpus_pipeline.packing_stage(spark, named, SMALL)
    assert packed.where("doc_id = 'd14'").count() == 1


def test_losses_that_were_seen(spark):
    docs = spark.createDataFrame([(0, "b"), (1, "a"), (1, "b"), (1, "a")], "doc_id long, text string")
    for drop in (exact_dedup.drop_exact_copies, minhash.drop_near_copies):
        assert sorted(tuple(r) for r in drop(docs).collect()) == [(0, "b"), (1, "a")]


def test_row_keys_differ_in_every_row(spark):
    top = (1 << 63) - 1
    for ids in ([1, 2, 3], [1, 1, None, None, -5], [top, top, 3], [None] * 4, []):
        rows, key = common.with_row_key(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
        keys = [r[key] for r in rows.collect()]
        assert len(set(keys)) == len(ids) and None not in keys


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_join_equals_plain_join(spark, how, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    left = spark.range(400).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 90).alias("k"), "id")
    right = spark.createDataFrame([(k, f"r{k}{x}") for k in range(0, 80) for x in "ab"[: 1 + k % 2]] + [(None, "n")], "k long, v string")
    got = common.split_join(left, right, ["k"], F.col("id"), how)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_scratch_tables_can_be_dropped(spark):
    since = len(common._WRITTEN)
    kept = common.scratch_table(spark.range(3), "kept")
    assert kept.count() == 3
    folder = common._WRITTEN[since]
    common.drop_scratch(spark, since)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert len(common._WRITTEN) == since and not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
