"""Spelling variants against a comparison of all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from lumenframe.llm import spelling


def plain_counts(rows):
    n = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def plain_forms(n):
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in around.items():
        top = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    got = df.collect()
    assert len(got) == len({r.word for r in got})
    return {tuple(r) for r in got}


@pytest.mark.parametrize("letters", ["ab", "aàÿ×", "abcdefgh"])
def test_forms_equal_all_pairs(spark, letters):
    """Few letters make many neighbours, equal letters in a row and words inside words."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(250)}
    for w in list(words)[:60]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]}
    words |= {"a" * k for k in range(7, 40)} | {"b" * 300, "b" * 299 + "a", "a" + "b" * 299, "b" * 150 + "a" + "b" * 149, "b" * 301}
    n = {w: 2 * 10 ** rng.randint(0, 6) for w in words if len(w) >= 7}
    assert rows_of(spelling.forms(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_forms(n)


def test_words_of_texts(spark):
    rng = random.Random(3)
    base = ["colour-ing", "Grüßgott", "ÀÉÎÕÜÝÞ", "straße÷×", "variants", "VARIANTS", "variant", "variantes", "seventy", "sevent", "ſtraßen", "x1longword2", "Kelvins"]
    rows = [(i, " ".join(rng.choices(base, k=80))) for i in range(120)]
    rows += [(1, rows[1][1])] * 2 + [(None, "variants variants"), (205, None), (206, ""), (-3, "z" * 50_000 + " " + "z" * 50_000), (207, "1 2 3 \n")]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    want = plain_counts(rows)
    assert any(w not in {x.lower() for x in base} for w in want)
    assert {r.word: r.n for r in spelling.count_words(docs).collect()} == want
    assert rows_of(spelling.spelling_forms(docs)) == plain_forms(want)
    assert spelling.spelling_forms(docs.where("doc_id > 1000")).collect() == []
    assert spelling.spelling_forms(docs.where("doc_id in (205, 206, 207)")).collect() == []


def test_chain_of_forms(spark):
    n = {"abcdefg" + "h" * k: 10 ** (6 - k) * 2 for k in range(6)} | {"unrelated": 3}
    got = {r.word: r for r in spelling.forms(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got["abcdefghhhhh"].form == "abcdefghhhh" and got["abcdefghhhhh"].root == "abcdefg"
    assert (got["unrelated"].form, got["unrelated"].root, got["unrelated"].n_near) == (None, "unrelated", 0)
