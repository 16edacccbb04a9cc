"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import bpe, chat, entries, exact_dedup, langid, media, minhash, packing, pii, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, bucket string, _dropped_id long, _found int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    base = [rng.choice(words) for _ in range(200)]
    out = [None, "", " \t\n", "one", "One  ONE", "a b c d", "a b c d e", "É é ñ 中文 words", "x" * 120_000, " ".join(rng.choice(words) for _ in range(25_000))]
    out += [" ".join(base)] * 7 + ["  ".join(base), " ".join(base).upper()]
    for k in range(60):  # a star: each copy is near the original, few are near each other
        copy = list(base)
        for at in rng.sample(range(200), 2):
            copy[at] = "edit%d_%d" % (k, at)
        out.append(" ".join(copy))
    for k in range(30):
        out.append(" ".join(base[:60] + [rng.choice(words) for _ in range(rng.randint(20, 300))]))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 7 == 0 else "s%d" % (i % 3 and 1), None, 1.0, "d", "b", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12]]  # repeated rows
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_minhash_equals_brute_force(docs, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for r in minhash.near_copies(docs).collect():
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == find(r.doc_id), r
        assert r.kept == (r.doc_id == r.component_id)


def test_minhash_without_ids_and_rows(spark, docs, empty):
    got = minhash.near_copies(spark.createDataFrame([(None, "a b c"), (None, None), (4, "a b c")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (4, 4, True)}
    assert minhash.near_copies(empty).count() == 0
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_minhash_finds_pairs_inside_boilerplate(spark):
    rng = np.random.default_rng(3)

    def fresh_words(k):
        return [f"w{x}" for x in rng.integers(0, 10**9, k)]

    boilerplate, texts = fresh_words(370), []
    for _ in range(100):  # pairs at 0.865 among texts at 0.843
        common = fresh_words(5)
        texts += [" ".join(boilerplate + common + fresh_words(29)) for _ in range(2)]
    texts += [" ".join(boilerplate + fresh_words(34)) for _ in range(400)]
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (n := len(sets[i] & sets[j])) >= 85 * (len(sets[i]) + len(sets[j]) - n)]
    assert linked == [(i + 1, i) for i in range(0, 200, 2)]
    got = minhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - i % 2 if i < 200 else i for i in range(600)}


@pytest.mark.parametrize("block", [minhash.BLOCK, 20])
def test_minhash_recall_on_chains_and_dense_clusters(spark, monkeypatch, block):
    """Chains whose ends have nothing in common, and clusters of many near copies: all
    components are those that all links give."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(6):
        words_ = [f"w{x}" for x in rng.integers(0, 10**9, 1500)]
        texts += [" ".join(words_[i * 20 : i * 20 + 400]) for i in range(55)]  # 376 of 416 shingles in common: 0.904
    for _ in range(3):
        words_ = [f"w{x}" for x in rng.integers(0, 10**9, 300)]
        for _ in range(60):
            copy = list(words_)
            for at in rng.choice(300, 3, replace=False):
                copy[at] = f"v{rng.integers(0, 10**9)}"
            texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    smallest = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((smallest[i], smallest[j]))
                smallest = [a if x == b else x for x in smallest]
    assert len(set(smallest)) < 120
    got = {r.doc_id: r.component_id for r in minhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(smallest))


def test_minhash_of_one_large_cluster_with_few_links(spark):
    """500 texts about as similar as the limit, of which few pairs are linked."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**9, 250)]
    texts = []
    for k in range(500):
        copy = list(base)
        for at in rng.choice(250, 3, replace=False):
            copy[at] = f"v{k}_{at}"
        texts.append(" ".join(copy))
    sets = [np.array(sorted(map(hash, shingles(t)))) for t in texts]
    parent = list(range(500))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in range(500):
        for j in range(i):
            if minhash.similar_sets(sets[i], sets[j]):
                links += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert 20 < links < 3000
    got = {r.doc_id: r.component_id for r in minhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(500)}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)}


def test_exact_groups_equal_brute_force(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), i))
    got = exact_dedup.exact_groups(docs, heavy=2, tracked=16).collect()
    assert len(got) == len(rows)
    of = dict(rows)
    for r in got:
        key = re.sub("[\x20\x09-\x0d]", "", of[r.doc_id])
        assert (r.keep_id, r.group_size) == (min(groups[key])[1], len(groups[key]))
        assert r.text_sha256 == hashlib.sha256(key.encode()).hexdigest() and r.kept == (r.keep_id == r.doc_id)


def test_exact_groups_edge_tables(spark, docs, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    lone = exact_dedup.exact_groups(spark.createDataFrame([(None, "x")], "doc_id long, text string")).first()
    assert lone.keep_id is None and lone.kept
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert kept.select("doc_id").distinct().count() == exact_dedup.exact_groups(docs).where("kept").select("doc_id").distinct().count()


def minimax(sizes, k):
    lo, hi = max([*sizes, 0]), sum(sizes)
    while lo < hi:
        mid, shards, room = (lo + hi) // 2, 1, (lo + hi) // 2
        for s in sizes:
            if s > room:
                shards, room = shards + 1, mid
            room -= s
        lo, hi = (lo, mid) if shards <= k else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("shards,splits", [(8, 256), (3, 1), (1, 2), (40, 7)])
def test_sharding_is_minimax(docs, shards, splits):
    rows = {}
    sizes = defaultdict(int)
    for r in docs.collect():
        t = (r.text or "").encode()
        rows[r.doc_id] = t
        sizes[hashlib.sha256(t).hexdigest()] += len(t) + 1
    got = sharding.shard_by_bytes(docs, shards=shards, splits=splits, slot_parts=4).collect()
    load, slots, of_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        assert r["size"] == len(rows[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(rows[r.doc_id])
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of_text[rows[r.doc_id]].add(r.shard)
    assert len(got) == docs.count() and set(load) <= set(range(shards))
    capacity = minimax([s for _, s in sorted(sizes.items())], shards)
    assert max(load.values()) == capacity
    greedy, shard, room = {}, 0, capacity  # the cuts are where the greedy fill ends its shards
    for digest, size in sorted(sizes.items()):
        if size > room:
            shard, room = shard + 1, capacity
        room -= size
        greedy[digest] = shard
    assert {hashlib.sha256(t).hexdigest(): next(iter(of)) for t, of in of_text.items()} == greedy
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_sharding_of_nothing(empty):
    assert sharding.shard_by_bytes(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_minimax_cuts_of_many_groups(spark, seed, monkeypatch):
    """Buckets of one digit, so that they are split many times; one group may be huge."""
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    rng = random.Random(seed)
    sizes = {hashlib.sha256(str((seed, i)).encode()).hexdigest(): rng.choice([1, 1, 2, 50, rng.randint(1, 400)]) for i in range(800)}
    if seed % 2:
        sizes[rng.choice(list(sizes))] = 60_000
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(list(sizes.items()), "digest string, size long"), 8, splits=5)
    assert capacity == minimax([s for _, s in sorted(sizes.items())], 8)
    want, room, found = 0, capacity, []
    for digest, size in sorted(sizes.items()):
        if size > room:
            want, room = want + 1, capacity
        room -= size
        found.append(sum(c is not None and digest >= c for c in cuts) == want)
    assert all(found)


def plain_encoding():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_bpe_equals_tiktoken(docs):
    path, enc = plain_encoding()
    some = docs.withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(some, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert len(out) == docs.count()
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_bpe_safe_pieces():
    _, enc = plain_encoding()
    rng = random.Random(1)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "1", "22", "'s", "é", " ", " ", "\x1c", "中", "!", "...", "'", "\x85"]
    for _ in range(200):
        text = "".join(rng.choice(alphabet) for _ in range(300))
        pieces = list(bpe.safe_pieces(text, 7))
        assert "".join(pieces) == text
        assert sum((enc.encode_ordinary(p) for p in pieces), []) == enc.encode_ordinary(text)


def by_hand(text):
    """Token ids from the pattern and the ranks alone."""
    import regex

    path, _ = plain_encoding()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    out = []
    for m in regex.finditer(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in m[0].encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        out += [ranks[x] for x in parts]
    return out


def test_bpe_of_white_space_by_hand(monkeypatch):
    """Runs of white space that are cut out of the text, against the pattern applied by hand."""
    _, enc = plain_encoding()
    monkeypatch.setattr(bpe, "LONG_RUN", 5)
    monkeypatch.setattr(bpe, "_LONG", re.compile(f"[{bpe.WHITE}]{{6,}}"))
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bc", "1", "'s", "!", "é", *([" ", "\n", "\t", "\u3000"][k % 4] * rng.randint(1, 30) for k in range(8))]) for _ in range(12))
        assert bpe.encode_text(enc, text).tolist() == by_hand(text) == enc.encode_ordinary(text)


@pytest.mark.parametrize("run", [" ", "\n", "\r\n", "\u2003\t"])
def test_bpe_of_five_million_blanks(spark, run):
    path, enc = plain_encoding()
    many = run * (5_000_000 // len(run))
    texts = [many, "a" + many + "b", many + "\nb c", "x " + many]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = bpe.decode(bpe.encode(d, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in out.select("doc_id", bpe.token_count("ids").alias("n"), F.sha2("decoded", 256).alias("h"), F.substring("ids", 1, 4).alias("first")).collect()}
    assert {i: r.h for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    short = [bpe.encode_text(enc, t) for t in (run * 10, "a" + run * 10 + "b")]
    assert int.from_bytes(bytes(got[0].first), "little") == short[0][0] and int.from_bytes(bytes(got[1].first), "little") == short[1][0]


def test_packing_equals_plain_best_fit():
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 5, 90, 100, 101, 250, *range(1, 60)]), rng.choice(["a", "a", "b", "c", None]), rng.choice([None, "k1", "k2", str(i)])) for i in range(300)]
    got = packing.pack_rows(rows, 100)
    bins = []
    pieces = sorted(((min(100, s - 100 * k), r, k) for r, (_, s, _, _) in enumerate(rows) for k in range(max(1, -(-s // 100)))), key=lambda p: (-p[0], p[1], p[2]))
    for (size, r, k), (row, piece, start, sz, b, offset) in zip(pieces, got, strict=True):
        src, clu = rows[r][2], rows[r][3]
        fits = [(100 - x["used"], i) for i, x in enumerate(bins) if 100 - x["used"] >= size and (100 > x["used"] or x["open"]) and not (src in x["src"] and src is not None) and not (clu in x["clu"] and clu is not None)]
        room, want = min(fits, default=(100, len(bins)))
        if want == len(bins):
            bins.append({"used": 0, "src": set(), "clu": set(), "open": False})
        assert (row, piece, start, sz, b, offset) == (r, k, 100 * k, size, want, bins[want]["used"])
        bins[want]["used"] += size
        bins[want]["src"].add(src)
        bins[want]["clu"].add(clu)
        bins[want]["open"] = size == 0


def test_packing_keeps_whole_texts(docs, empty):
    text = F.coalesce("text", F.lit(""))
    out = packing.pack(docs, F.char_length(text), F.col("source"), F.xxhash64(text), group=50).collect()
    whole = defaultdict(int)
    load = defaultdict(int)
    for r in out:
        whole[r.doc_id] += r["size"]
        load[r.bin_id] += r["size"]
    assert max(load.values()) <= packing.CAPACITY
    want = defaultdict(int)
    for r in docs.collect():
        want[r.doc_id] += len(r.text or "")
    assert whole == want
    assert packing.pack(empty, F.lit(1), F.col("source"), F.lit("c")).count() == 0


def test_packing_keeps_ids_and_conflicts(spark):
    rng = random.Random(11)
    big = 1_152_921_504_606_846_977
    rows = [(big + i, rng.randint(0, 900), rng.choice(["hot", "hot", "b", "c", None]), rng.choice(["k1", "k2", None, f"u{i}"])) for i in range(300)]
    rows += [(None, 10, "hot", "k1")] * 3 + [(None, 0, None, None)] * 40 + [rows[0]] * 3 + [(5, None, "x", "y")]
    d = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, size long, source string, cluster string, _key int, bin_id string")
    got = packing.pack(d, F.col("size"), F.col("source"), F.col("cluster"), capacity=1000, group=64).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), r[1] or 0) for r in rows)
    in_bin = defaultdict(list)
    of = {(r[0], r[1] or 0): r for r in rows}
    for r in got:
        in_bin[r.bin_id].append(r)
    for pieces in in_bin.values():
        for col in (2, 3):
            values = [v for p in pieces if (v := of[p.doc_id, p["size"]][col]) is not None]
            assert len(values) == len(set(values))
        at = 0
        for p in sorted(pieces, key=lambda p: (p.bin_at, p["size"])):
            assert p.bin_at == at
            at += p["size"]
        assert {p.bin_free for p in pieces} == {1000 - at}


def test_equal_rows_are_dealt_to_many_groups(spark):
    d = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"))
    got = packing.pack(d, F.lit(0), F.lit(None), F.lit("same"), group=100)
    sizes = [r[1] for r in got.groupBy(F.floor(F.col("bin_id") / (1 << 24))).count().collect()]
    assert sum(sizes) == 5000 and max(sizes) < 200


def gram_counter(text):
    kept = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    return Counter(kept[i : i + k] for k in langid.ORDERS for i in range(len(kept) - k + 1))


def test_language_equals_plain_naive_bayes(spark):
    """Log-probabilities from plain counts of the same buckets; repeated rows count twice,
    equal languages tie to the first name, clashing columns are ignored."""
    rng = random.Random(9)
    voc = {"aa": "kala mulu taka rima éta", "bb": "kala mulu taka rima éta", "cc": "strz prch vlk skrz ŷl"}
    rows = [(i, " ".join(rng.choice(voc[lang].split()) for _ in range(rng.randint(1, 40))) + " 7!", lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    same = " ".join(rng.choice(voc["aa"].split()) for _ in range(30))
    rows = [r for r in rows if r[2] == "cc"] + [(i, same, lang) for i in (1001, 1002, 1003) for lang in ("aa", "bb")] + [rows[2]] * 2
    d = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    held = {r.doc_id for r in d.where(langid.fold(F.col("doc_id"))).collect()}

    def bucket(gram):
        h = 0
        for k, c in enumerate(gram, 1):
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + k) % 2**64
        return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64) >> 50

    counts = {x: Counter() for x in voc}
    for i, t, lang in rows:
        if i not in held:
            for g, n in gram_counter(t).items():
                counts[lang][bucket(g)] += n
    n = Counter(lang for i, _, lang in rows if i not in held)
    total = {x: sum(c.values()) + langid.PSEUDO_COUNT * langid.BUCKETS for x, c in counts.items()}

    def plain(text):
        logs = {x: np.log(n[x] / sum(n.values())) + sum(k * np.log((counts[x][bucket(g)] + langid.PSEUDO_COUNT) / total[x]) for g, k in gram_counter(text).items()) for x in voc}
        best = min(logs, key=lambda x: (-round(logs[x], 9), x))
        return best, 1 / sum(np.exp(v - logs[best]) for v in logs.values())

    assert n["aa"] == n["bb"]
    got = langid.predict(d, langid.fit(d)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "lang_pred", "score"]
    want = {i: plain(t) for i, t, _ in rows}
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-6
    assert {r.lang_pred for r in got if r.doc_id > 1000} == {"aa"}
    sampled = langid.predict(d, langid.fit(d, max_training=12)).collect()
    assert all(r.lang_pred == want[r.doc_id][0] for r in sampled if r.doc_id < 1000)


@pytest.mark.parametrize("op,floor", [("op5_langid", 0.98), ("op7_toxicity", 0.95)])
def test_held_out_accuracy(spark, op, floor):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = entries.QUERIES[op](spark, folder).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    if op == "op5_langid":
        right = [r.lang_pred == r.lang for r in got if r.lang is not None and r.lang_pred != "und"]
    else:
        right = [r.predicted == r.toxic for r in got if r.toxic is not None]
    assert len(right) > 50 and sum(right) >= floor * len(right)


def test_language(spark, empty):
    rng = random.Random(2)
    voc = {"xx": ["kala", "mulu", "taka", "rima"], "yy": ["strz", "prch", "vlk", "skrz"]}
    rows = []
    for i in range(400):
        lang = ["xx", "yy", None][i % 3]
        rows.append((i, None if i % 50 == 9 else " ".join(rng.choice(voc[lang or "xx"]) for _ in range(rng.randint(3, 30))), lang))
    rows += [(1000, "123 !!", "xx"), (1001, "", "yy"), (1002, "kala " * 30_000, None), (None, "prch vlk", "yy")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    got = {r.doc_id: r for r in langid.predict(d, model).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        r = got[i]
        assert 0 <= r.score <= 1
        if not t or not any(c.isalpha() for c in t):
            assert r.lang_pred == "und"
        elif lang:
            assert r.lang_pred == lang
    assert {r.lang_pred for r in langid.predict(d, langid.fit(empty)).collect()} == {"und"}


def test_toxicity(spark, empty):
    rng = random.Random(4)
    calm = ["tree", "river", "stone", "cloud", "women", "muslims", "house"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [rng.choice(calm) for _ in range(rng.randint(3, 40))] + (["vexword", "women"] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), "keep"))
        labels.append((i, int(bad)))
    rows += [(1000, None, "keep"), (1001, "", "keep"), (1002, "river " * 30_000, "keep"), (1003, "jews and women of the house", "keep")]
    labels += [(1001, None), (None, 1)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(600))
    assert max(got[k] for k in (1000, 1001, 1002, 1003)) < 0.3
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and kept.count() == len(rows) - 120
    assert toxicity.score(d, toxicity.fit(empty, lab)).where("score >= 0.3").count() == 0


def group_rows(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1000):
        bad = i % 2
        w = [rng.choice(["sun", "moon", "star", "sky"]) for _ in range(3)]
        if bad and rng.random() < 0.8:
            w.append("vile")
        if rng.random() < (0.7 if bad else 0.1):
            w.append("muslims")
        rows.append((i, " ".join(w), bad))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_counterfactual_penalty_frees_group_terms(spark):
    """In the sample one group stands mostly in toxic sentences; a swapped copy must not score differently."""
    d = group_rows(spark)
    gap = {}
    for name, weight in (("with", toxicity.COUNTERFACTUAL), ("without", 0.0)):
        m = toxicity.fit(d.select("doc_id", "text"), d, counterfactual=weight)
        gap[name] = abs(m.score("muslims sun") - m.score("christians sun"))
        assert m.score("vile sun") > 0.5 > m.score("sun moon")
    assert gap["with"] < 0.5 * gap["without"]


def test_swaps_are_live_on_the_given_labels(spark):
    """The labelled texts hold neutral words, so that the penalty changes the fit: scores
    of held-out texts move less when neutral words are swapped, and are no less right."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    texts = [(r.text, r.toxic) for r in docs.join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) & F.col("toxic").isNotNull()).collect()]
    known = docs.join(labels, "doc_id").where("toxic is not null").select(F.col("toxic").cast("int").alias("label"), F.col("text").alias("_text"))
    n = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    neutral = toxicity.neutral_words(known, n[0], n[1])
    assert 100 < len(neutral) <= toxicity.MAX_NEUTRAL and "idiot" not in neutral
    to = toxicity.swaps(neutral)
    moved, right = {}, {}
    for name, weight in (("with", toxicity.COUNTERFACTUAL), ("without", 0.0)):
        m = toxicity.fit(docs, labels, counterfactual=weight)
        pairs = [(m.score(t), m.score(" ".join(sorted(toxicity.swapped(toxicity.words_of(t), to) or toxicity.words_of(t))))) for t, _ in texts]
        moved[name] = np.mean([abs(p - q) for p, q in pairs])
        right[name] = np.mean([(p >= toxicity.THRESHOLD) == bool(y) for (p, _), (_, y) in zip(pairs, texts, strict=True)])
    assert moved["with"] < 0.8 * moved["without"] and right["with"] >= right["without"] - 0.01


def test_toxicity_sample_and_features_equal_brute_force(spark):
    """Features chosen by Spark against plain counts; a bounded sample, repeated rows and
    contradicting labels."""
    d = group_rows(spark).select(F.col("toxic").alias("label"), F.col("text").alias("_text"))
    found = toxicity.scratch_table(d.mapInArrow(lambda b: toxicity._extract(b, {}), toxicity._FEATURES), "features")
    count = {0: Counter(), 1: Counter()}
    for r in d.collect():
        count[r.label].update(toxicity.features(toxicity.words_of(r._text)).tolist())
    want = []
    for f in {*count[0], *count[1]}:
        share = (count[0][f] + count[1][f]) / 1000
        gap = abs(count[1][f] - count[0][f]) / 500 / np.sqrt(max(share * (1 - share), 1e-9) / 250)
        if count[0][f] + count[1][f] >= 3 and gap > 3:
            want.append(f)
    assert toxicity.chosen_features(found, 500, 500).tolist() == sorted(want)
    whole = group_rows(spark)
    twice = whole.unionByName(whole.limit(50))
    labels = whole.select("doc_id", "toxic").unionByName(whole.where("doc_id < 30").select("doc_id", (1 - F.col("toxic")).alias("toxic")))
    m = toxicity.fit(twice, labels, max_per_class=200)
    assert m.score("vile sun") > 0.5 > m.score("sun moon")


def test_chat_reads_back(spark):
    rows = [
        (1, 0, "system", "be <|kind|> 100%"), (1, 1, "user", None), (1, 2, "user", "[INST] \\ %3C </s>"), (1, 3, "assistant", "a"), (1, 4, "assistant", ""), (1, 5, "assistant", "<s>é中"),
        (2, 0, "assistant", "x" * 50_000), (2, 0, "assistant", "x" * 50_000), (2, None, None, "t"), (None, 1, "odd|<role", "<|end|>\n<|same|>"),
    ]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(d)).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(x.role, x.text) for x in got[c].turns] == [t[1:] for t in turns]
        assert got[c].loss_text == "".join(t[2] for t in turns if t[1] == "assistant")
        spans = [got[c].formatted[s.start - 1 : s.start - 1 + s.length] for s in got[c].loss_spans]
        assert len(spans) == sum(t[1] == "assistant" for t in turns)
    assert chat.format_chats(d.limit(0)).count() == 0


def luhn(n):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(n)))) % 10 == 0


def test_pii_keeps_formats_and_links(spark, empty):
    text = "card 4111 1111 1111 1111 and 4111111111111111, bad 4111111111111112; ip 10.0.0.1 not 300.1.1.1; +1 (523) 555-1055; born 1999-12-31, 31.12.1999, 12/31/1999, never 2023-02-30; 123-45-6789; Jo.doe9@x.org; key " + "ab12" * 10
    rows = [(1, text), (2, text), (3, None), (4, ""), (5, "calm text 12"), (6, "z " * 60_000 + "10.0.0.1")]
    d = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, _found int, n_card string")
    out = {r.doc_id: r for r in pii.pseudonymise(d, "k", count_cols=True).collect()}
    got = out[1].text
    assert out[2].text == got and out[3].text is None and out[4].text == "" and out[5].text == "calm text 12"
    cards = re.findall(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})", got)[0]
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and luhn(cards[1])
    assert "4111111111111112" in got and "300.1.1.1" in got and "2023-02-30" in got
    ip = re.search(r"ip (\S+) not", got)[1]
    assert ip != "10.0.0.1" and all(int(x) < 256 for x in ip.split(".")) and out[6].text.endswith(ip)
    y, m, dd = re.search(r"born (\d{4})-(\d\d)-(\d\d)", got).groups()
    assert f"{dd}.{m}.{y}" in got and f"{m}/{dd}/{y}" in got and (y, m, dd) != ("1999", "12", "31")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4};", got) and "555-1055" not in got and "123-45-6789" not in got
    assert re.search(r"; [A-Z][a-z]\.[a-z]{3}\d@x\.org", got) and "Jo.doe9" not in got
    assert re.search(r"key [0-9a-f]{40}$", got) and "ab12ab12" not in got
    assert (out[1].n_card, out[1].n_date, out[1].n_ip, out[1].n_ssn, out[1].n_phone, out[1].n_email, out[1].n_secret) == (2, 3, 1, 1, 1, 1, 1)
    assert pii.pseudonymise(d, "other").where("doc_id = 1").first().text != got
    assert pii.pseudonymise(empty, "k").columns == empty.columns


def test_feistel_is_a_permutation(spark):
    d = spark.range(35).select((F.col("id") % 5).alias("l"), F.floor(F.col("id") / 5).alias("r"))
    got = d.select(pii.feistel(F.col("l"), F.col("r"), F.lit(5), F.lit(7), "k", "t").alias("p")).select("p.left", "p.right").collect()
    assert {(r.left, r.right) for r in got} == {(a, b) for a in range(5) for b in range(7)}
    days = spark.range(0, 146097, 61).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    made = days.select(F.col("d"), pii.date(F.col("d"), "k").alias("p")).collect()
    assert len({r.p for r in made}) == len(made) and all(re.fullmatch(r"(1[89]|2[01])\d\d-\d\d-\d\d", r.p) for r in made)


def test_media_finds_copies(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=64).tolist(), "x") for i in range(120)]
    vectors += [(207, vectors[0][1], "x"), (201, None, None), (202, [], "x"), (203, [0.0] * 64, "x"), (None, vectors[1][1], "x")]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, edit string")
    images = media.images_of(v, F.col("vec_id") % 50 == 0)
    got = media.find_copies(images, (F.col("edit") == "none") & (F.col("image_id") % 50 == 0)).collect()
    member = {r.image_id: r.class_id for r in got if r.match_id is None}
    assert member[207] == 0 and len([r for r in got if r.match_id is None]) == images.count()
    found = {(r.image_id, r.match_id): r.votes for r in got if r.match_id is not None}
    want = {(i, -(len(media.EDITS) * i + k + 1)) for i in (0, 50, 100) for k in range(len(media.EDITS))}
    assert want <= set(found) and len(set(found) - want) <= 1
    # brute force: every query against every class in full
    described = {r.image_id: np.frombuffer(bytes(r.corners), media.CORNER) for r in media.describe(images, F.lit(True)).collect() if r.image_id is not None}
    classes = {c for c in member.values() if c is not None}
    for q in (0, 50, 100):
        votes = {j: media.consensus(described[q], described[j]) for j in classes - {q}}
        close = {j for j, n in votes.items() if n >= media.MIN_VOTES}
        assert all(found.get((q, j)) == votes[j] for j in close & {m for i, m in found if i == q})
        assert len({(q, j) for j in close} - set(found)) <= 0.1 * len(close)
    assert media.find_copies(images.limit(0), F.lit(True)).count() == 0


def test_media_leaves_out_no_pair_that_meets_the_threshold(spark, monkeypatch):
    """Edits that leave no half of a corner's bits as it was; cells and slabs of a few
    images.  All pairs and votes are those of the comparison in full."""
    monkeypatch.setattr(media, "CELL", 8)
    rng = np.random.default_rng(3)
    texts = [media.render(rng.normal(size=64).astype(np.float32)) for _ in range(12)]
    halves = [((a[1:].astype(int) + a[:-1]) // 2).astype(np.uint8) for a in texts]
    small = [media._scaled(a[6:-6, 6:-6].astype(np.float32), 1.25).astype(np.uint8) for a in texts]
    rows = [(i, a.shape[1], a.shape[0], a.tobytes()) for i, a in enumerate([*texts, *halves, *small])]
    images = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")
    described = [media.describe_image(a) for a in (*texts, *halves, *small)]
    want = {(q, j): media.consensus(described[q], described[j]) for q in range(12) for j in range(36) if q != j}
    want = {pair: n for pair, n in want.items() if n >= media.MIN_VOTES}
    split = [media.consensus_of_all(described[:12], described[at : at + 16]) for at in (0, 16, 32)]
    assert {(i, at + j): n for at, part in zip((0, 16, 32), split, strict=True) for i, j, n in zip(*(x.tolist() for x in part), strict=True) if i != at + j} == want
    found = lambda exact: {(r.image_id, r.match_id): r.votes for r in media.find_copies(images, F.col("image_id") < 12, exact).collect() if r.match_id is not None}
    assert found(True) == want
    assert found(False).items() < want.items()


EDITS = {
    **media.EDITS,
    "gamma 0.7": lambda a: (255 * (a / 255) ** 0.7).astype(np.uint8),
    "gamma 1.5": lambda a: (255 * (a / 255) ** 1.5).astype(np.uint8),
    "noise": lambda a: np.clip(a + np.random.default_rng(0).normal(0, 4, a.shape), 0, 255).astype(np.uint8),
    "blur": lambda a: media._box(a.astype(np.float32), 1).astype(np.uint8),
    "shrink 0.8": lambda a: media._scaled(a.astype(np.float32), 1.25).astype(np.uint8),
}


@pytest.mark.parametrize("edit", EDITS)
def test_descriptors_survive_edits(edit):
    """Recall of each edit on 40 textures: meeting in the tables and consensus."""
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(40):
        a = media.render(rng.normal(size=64).astype(np.float32))
        p, q = media.describe_image(a), media.describe_image(np.ascontiguousarray(EDITS[edit](a)))
        meet = np.intersect1d(media.table_keys(p), media.table_keys(q))
        hits += len(meet) > 0 and media.consensus(p, q) >= media.MIN_VOTES
    assert hits >= 36


def test_images_without_corners():
    assert not len(media.describe_image(np.zeros((8, 8), np.uint8))) and not len(media.describe_image(np.full((96, 96), 7, np.uint8)))
    assert media.table_keys(np.empty(0, media.CORNER)).shape == (0, 2)


def test_every_numbered_query_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in entries.QUERIES} == set(range(1, 11))


def test_matches_that_cannot_agree_do_not_vote():
    """Scale and turn are counted first; six matches that share both stay, others of the
    same pair go."""
    a, b = np.zeros(9, media.CORNER), np.zeros(9, media.CORNER)
    a["angle"][:6], b["angle"][:6] = range(0, 60, 10), range(64, 124, 10)
    b["angle"][6:] = 128, 150, 200
    i = np.arange(9)
    assert media._may_agree(a, b, i, i, np.zeros(9, int)).tolist() == [True] * 6 + [False] * 3
    assert not media._may_agree(a, b, i, i, i % 2).any() and not len(media._may_agree(a, b, i[:0], i[:0], i[:0]))
