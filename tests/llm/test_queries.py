"""Every numbered query on the smallest tables: against its SQL where it has one, and a
row for each row of its table."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from lumenframe.llm import entries

from ..oracle import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_equals_sql(spark, con, name):
    assert difference(entries.QUERIES[name](spark, SMALL), entries.SQL[name], con) == ""


@pytest.mark.parametrize("name", [n for n in entries.QUERIES if n not in entries.SQL])
def test_covers_its_whole_table(spark, con, name):
    got = entries.QUERIES[name](spark, SMALL)
    if name == "op9_media":
        whole = con.sql("select count(*) + 3 * count(*) filter (vec_id % 50 = 0) from embeddings").fetchall()[0][0]
        assert got.where("match_id is null").count() == whole
        return
    ids = {r[0] for r in con.sql("select doc_id from documents").fetchall()}
    assert {r.doc_id for r in got.select("doc_id").collect()} == ids
    assert name == "op3_packing" or got.count() == len(ids)


def test_sharding_contract(spark, con):
    rows = {r[0]: (r[1] or "").encode() for r in con.sql("select doc_id, text from documents").fetchall()}
    got = entries.op10_sharding(spark, SMALL).collect()
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(rows[r.doc_id]) + 1, zlib.crc32(rows[r.doc_id]), "bytes", None) for r in got)
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_bpe_contract(spark, con):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] or "" for r in con.sql("select doc_id, text from documents").fetchall()}
    for r in entries.op2_bpe(spark, SMALL).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_key_of_the_pseudonyms_stays_out_of_the_plan(spark, tmp_path):
    (tmp_path / "key").write_text("swordfish\nnot the key")
    docs = spark.createDataFrame([(1, "from 10.0.0.1 on 1999-12-31, jo@x.org, 4111 1111 1111 1111")], "doc_id long, text string")
    spark.conf.set(entries.KEY_FILE, str(tmp_path / "key"))
    try:
        got = entries.pii.pseudonymise(docs, entries.pseudonym_key(spark), count_cols=True)
    finally:
        spark.conf.unset(entries.KEY_FILE)
    want = entries.pii.pseudonymise(docs, "swordfish", count_cols=True)
    assert got.collect() == want.collect() and got.first().text != docs.first().text
    assert "swordfish" not in got._jdf.queryExecution().toString() and "swordfish" in want._jdf.queryExecution().toString()
