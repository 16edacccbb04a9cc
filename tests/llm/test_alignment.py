"""Alignment of two tokenizers against a plain version on their own libraries."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from lumenframe.llm import alignment, entries

from ..oracle import connect

SMALL = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


def plain(rows, a, b):
    """(id, measures, groups) of each (id, text), token by token."""
    byte_of = alignment.byte_alphabet()

    def of_piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    found, docs_of = [], Counter()
    for id_, text in rows:
        links, groups = Counter(), []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [of_piece(i) for i in ids_b]
        if not text or b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            found.append((id_, [], [], links, groups))
            continue
        i = j = at_a = at_b = 0
        left, right = [], []
        while i < len(ids_a) or j < len(ids_b):
            if at_a <= at_b:
                left.append(i)
                at_a += len(bytes_a[i])
                i += 1
            else:
                right.append(j)
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b and left and right:
                spans = []
                for part, names, end in ((left, bytes_a, at_a), (right, bytes_b, at_b)):
                    start = end - sum(len(names[k]) for k in part)
                    ranges = []
                    for k in part:
                        ranges.append((k, start, start + len(names[k])))
                        start += len(names[k])
                    spans.append(ranges)
                for k, s, e in spans[0]:
                    for m, t, f in spans[1]:
                        if s < f and t < e:
                            links[ids_a[k], ids_b[m]] += 1
                groups.append(",".join(str(ids_a[k]) for k in left) + "|" + ",".join(str(ids_b[k]) for k in right))
                left, right = [], []
        found.append((id_, ids_a, ids_b, links, groups))
        docs_of.update(links.keys())
    best = defaultdict(int)
    for (x, _), n in docs_of.items():
        best[x] = max(best[x], n)
    return Counter(
        (id_, len(x), len(y), len(groups), sum(links.values()), sum(k for p, k in links.items() if docs_of[p] == best[p[0]]), sum(k * docs_of[p] for p, k in links.items()), ";".join(groups))
        for id_, x, y, links, groups in found
    )


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_query_equals_plain_version(spark, libraries):
    rows = connect(SMALL).sql("select doc_id, text from documents").fetchall()
    want = Counter()
    for r, n in plain(rows, *libraries).items():
        want[*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else ""] += n
    got = entries.op13_alignment(spark, SMALL)
    assert got.columns == ["doc_id", *alignment.MEASURES, "groups_sha256"]
    assert rows_of(got) == want


def test_odd_texts(spark, libraries, monkeypatch):
    """Nulls, empty texts, control strings, long runs, repeated rows and clashing columns."""
    texts = [None, "", " ", "  two  spaces ", "<|endoftext|> <s> <0x41> </s>", "▁ éÉ 中文 \U0001f600 \u0000\t\n", "don't we'll  1234567 ...---"]
    texts += ["a" * 3000, "word " * 3000, "\n" * 2000, "the cat", "the cat", "the cat sat", "́́x", "�﻿"]
    rows = [(i, t, b"x", "y", 1) for i, t in enumerate(texts)] + [(12, "the cat sat", b"x", "y", 1)] * 3 + [(None, "the dog", b"x", "y", 1), (None, None, b"x", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key binary, groups string, chunk int")
    assert rows_of(alignment.align(docs, *PATHS)) == plain([r[:2] for r in rows], *libraries)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 10)
    monkeypatch.setattr(alignment, "BATCH_CHARS", 10)
    assert rows_of(alignment.align(docs, *PATHS)) == plain([r[:2] for r in rows], *libraries)
    assert alignment.align(docs.where("doc_id > 100"), *PATHS).collect() == []
    assert [tuple(r) for r in alignment.align(docs.where("doc_id < 2"), *PATHS).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (0, 1)]


def test_vocabulary_in_json_is_that_of_the_ranks(libraries):
    texts = ["The quick brown fox's 42 hens!", " été   deux\n\n\ttrois", "你好, \U0001f600", "x" * 500]
    enc, _ = alignment.byte_level(*PATHS[:2])
    assert [enc.encode_ordinary(t) for t in texts] == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]
