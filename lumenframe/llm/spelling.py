"""Spelling variants: words that differ by one code point, found along a trie.

Two words one edit apart agree before the edit and behind it, and one of both parts is
at least half of the word.  So a word meets all its neighbours in two tries, one of the
words and one of the reversed words, with an edit in its later half only, where few words
branch off.  The tries are tables: a node is a hash of a prefix (neighbours are compared
as texts in the end), and edges lead over runs of nodes without branches, with the code
points they skip as label.  States (word, position, node, edits) are joined with the
table of edges level by level.  They start with no edit at the nodes of the word's own
path; there a code point is left out or replaced, after which the rest of the word must
be followed exactly.  States that end at the node of a word are neighbours.  An inserted
code point is one left out on the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_table, split_join
from .shingles import _WEIGHTS, _weights, mix

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: One in so many runs loses a code point.
DAMAGE = 31

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALL = 2**31 - 1
_SEEDS = np.array([0x8F1BBCDC62C1D6CA, 0x5BE0CD19137E2179], np.uint64)


def count_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", damage: int = DAMAGE) -> DataFrame:
    """word, n: the maximal runs [A-Za-z\\u00C0-\\u00FF]+ of all texts with A-Z lower-cased,
    of LEAST_LENGTH code points and LEAST_COUNT occurrences at least.

    Where damage divides the crc32 h of `<id>:<run>`, the run first loses its code point
    h % length; with damage 0 none does.  Null texts have no words; a null id is empty."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(runs).alias("run"))
    # lower() would also change letters beyond A-Z
    plain = F.octet_length("run") == F.char_length("run")
    found = found.withColumn("run", F.when(plain, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)))
    if damage:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        found = found.withColumn("h", h).select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))
        found = found.where(F.char_length("word") >= LEAST_LENGTH)
    else:
        found = found.select(F.col("run").alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


_PREFIX = "wid long, side int, depth int, node long, next int"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes of the later half of each word and reversed word: hash, depth and the
    code point behind (-1 at the end)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            words = part.column(1).to_pylist()
            points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
            size = np.array([len(w) for w in words])
            start = np.cumsum(size) - size
            place = np.arange(len(points)) - np.repeat(start, size)
            weights = (_WEIGHTS if size.max() <= len(_WEIGHTS) else _weights(int(size.max())))[place]
            low = (size - 1) // 2
            rows = size - low + 1
            depth = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows - low, rows)
            begin, whole = np.repeat(start, rows), np.repeat(size, rows)
            for side in (0, 1):
                x = points[np.repeat(start + size - 1, size) - place] if side else points
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(x.astype(np.uint64) + np.uint64(1)) * weights, dtype=np.uint64)])
                node = mix((sums[begin + depth] - sums[begin]) ^ _SEEDS[side]).view(np.int64)
                behind = np.where(depth < whole, np.append(x, -1)[begin + depth], -1)
                cols = [np.repeat(part.column(0).to_numpy(), rows), np.full(len(depth), side, np.int32), depth.astype(np.int32), node, behind.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["wid", "side", "depth", "node", "next"])


def _rest(text: Column, at: Column) -> Column:
    """text from the code point number at (from 0) on."""
    return F.substring(text, at + 1, F.lit(_ALL))


def tries(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ends, states) of both tries of words (wid, word).

    nodes: node, edges (first code point and rest of the label, child, whether a word ends
    at the child, labels that lead on from it); ends: node, of (the word that ends there); states: wid, node, rest: the
    nodes in the later half of each word's own path, and what follows."""
    prefixes = scratch_table(words.select("wid", "word").mapInArrow(_prefixes, _PREFIX), "prefixes")
    seen = prefixes.groupBy("node").agg(F.min("next").alias("least"), F.max("next").alias("most"))
    kept = seen.where("least <> most or least = -1").select("node")
    on_path = split_join(prefixes.select("wid", "side", "depth", "node"), kept, ["node"], F.col("wid"), "left_semi")
    paths = on_path.groupBy("wid", "side").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))
    text = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("text")
    paths = scratch_table(paths.join(words.select("wid", "word").hint("merge"), "wid").select("wid", "path", text), "paths")
    steps = paths.select(
        "text", F.explode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("up"), F.expr("slice(path, 2, size(path) - 1)").alias("down"))).alias("s")
    ).select("s.up.node", "s.down.node", F.substring("text", F.col("s.up.depth") + 1, F.col("s.down.depth") - F.col("s.up.depth")))
    edges = steps.toDF("node", "child", "label").groupBy("child").agg(F.first("node").alias("node"), F.first("label").alias("label"))
    edges = scratch_table(edges, "edges")
    ends = paths.select(F.element_at("path", -1)["node"].alias("node"), F.col("wid").alias("of"))
    # a node has an edge for each code point of the alphabet at most
    onward = edges.groupBy(F.col("node").alias("child")).agg(F.collect_list("label").alias("onward"))
    told = edges.join(onward.hint("merge"), "child", "left").join(ends.select(F.col("node").alias("child"), F.lit(True).alias("ends")).distinct().hint("merge"), "child", "left")
    leads = F.array_join(F.transform("onward", lambda label: F.substring(label, 1, 1)), "")
    edge = F.struct(
        F.substring("label", 1, 1).alias("lead"), _rest(F.col("label"), F.lit(1)).alias("behind"), "child",
        F.coalesce("ends", F.lit(False)).alias("ends"), F.coalesce(leads, F.lit("")).alias("leads"), F.coalesce("onward", F.array().cast("array<string>")).alias("onward"),
    )
    nodes = scratch_table(told.groupBy("node").agg(F.collect_list(edge).alias("edges")), "nodes")
    own = paths.select("wid", "text", F.explode("path").alias("at"))
    states = own.select("wid", "at.node", _rest(F.col("text"), F.col("at.depth")).alias("rest")).where("rest <> ''")
    return nodes, ends, states


def _moves(tail: str, fits) -> Column:
    """Children and what then is left of the text, over the edges that fit and from which
    the rest can go on or end.  tail is the text without the code point of the edge's lead."""

    def left(e: Column) -> Column:
        return F.when(e["behind"] == "", F.col(tail)).otherwise(_rest(F.col(tail), F.char_length(e["behind"])))

    def open_(e: Column) -> Column:
        text = left(e)
        onward = F.contains(e["leads"], F.substring(text, 1, 1)) & F.exists(e["onward"], lambda label: text.startswith(label))
        return fits(e) & F.col(tail).startswith(e["behind"]) & F.when(text == "", e["ends"]).otherwise(onward)

    return F.transform(F.filter("edges", open_), lambda e: F.struct(e["child"].alias("node"), left(e).alias("rest")))


def neighbours(words: DataFrame) -> DataFrame:
    """a, b: the word numbers of all ordered pairs of words (wid, word; distinct) that
    differ by exactly one inserted, deleted or replaced code point."""
    nodes, ends, states = tries(words)
    states = scratch_table(states, "states_0")
    first, tail = F.substring("rest", 1, 1), _rest(F.col("rest"), F.lit(1))
    met = split_join(states, nodes, ["node"], F.col("wid")).select("wid", "edges", first.alias("first"), tail.alias("tail"), F.substring("rest", 2, 1).alias("second"), _rest(F.col("rest"), F.lit(2)).alias("last"))
    replaced = _moves("tail", lambda e: F.col("first") != e["lead"])
    # of equal neighbouring code points the last one is left out
    left_out = _moves("last", lambda e: (F.col("first") != F.col("second")) & (F.col("second") == e["lead"]))
    front = scratch_table(met.select("wid", F.explode(F.concat(replaced, left_out)).alias("to")).select("wid", "to.*"), "states_1")
    done = states.where(F.char_length("rest") == 1).select("wid", "node").unionByName(front.where("rest = ''").select("wid", "node"))
    level = 1
    while not (going := front.where("rest <> ''")).isEmpty():
        level += 1
        met = split_join(going, nodes, ["node"], F.col("wid")).select("wid", "edges", first.alias("first"), tail.alias("tail"))
        followed = met.select("wid", F.explode(_moves("tail", lambda e: F.col("first") == e["lead"])).alias("to"))
        front = scratch_table(followed.select("wid", "to.*"), f"states_{level}")
        done = done.unionByName(front.where("rest = ''").select("wid", "node"))
    pairs = split_join(scratch_table(done, "done"), ends, ["node"], F.col("wid")).where("wid <> of")
    both = pairs.select(F.explode(F.array(F.struct(F.col("wid").alias("a"), F.col("of").alias("b")), F.struct(F.col("of").alias("a"), F.col("wid").alias("b")))).alias("p"))
    named = both.select("p.*").distinct()
    for side in ("a", "b"):
        named = named.join(words.select(F.col("wid").alias(side), F.col("word").alias(f"word_{side}")).hint("merge"), side)
    return named.where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def forms(words: DataFrame) -> DataFrame:
    """Per word of words (word, n; distinct): word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: smallest in code-point order), if
    that n is at least RATIO times its own; root is the end of the chain of forms, the
    word itself where it has none.  An empty table gives an empty result."""
    numbered = scratch_table(words.select("word", "n").withColumn("wid", F.monotonically_increasing_id()), "words")
    near = neighbours(numbered)
    named = near.join(numbered.select(F.col("wid").alias("b"), F.struct((-F.col("n")).alias("down"), "word").alias("top")).hint("merge"), "b")
    best = named.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min("top").alias("top"))
    chosen = (-F.col("top.down")) >= RATIO * F.col("n")
    known = numbered.join(best.withColumnRenamed("a", "wid").hint("merge"), "wid", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("top.word")).alias("form"), F.when(chosen, -F.col("top.down")).alias("form_n")
    )
    known = scratch_table(known, "forms")
    # n grows tenfold along a chain, so a few doublings reach its end
    links = scratch_table(known.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links_0")
    step = 0
    while not links.where("moved").isEmpty():
        step += 1
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = split_join(links.select("word", "root"), onward, ["root"], F.col("word"), "left")
        links = scratch_table(met.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"links_{step}")
    return known.join(links.select("word", "root").hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_forms(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", damage: int = DAMAGE) -> DataFrame:
    """The forms of the words of docs; see count_words and forms.

    Rows that repeat an id are texts like any other.  Other columns are ignored; an empty
    table, or one without words, gives an empty result."""
    return forms(scratch_table(count_words(docs, text_col, id_col, damage), "counted"))


SQL = r"""
WITH RECURSIVE table_256 AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY n) AS t
  FROM range(256) AS r(n)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, len(run) AS size, count(*) AS k FROM runs GROUP BY ALL HAVING len(run) >= 7),
bytes AS (
  SELECT *, flatten(list_transform(range(1, len(doc_id || ':' || run) + 1), lambda i: CASE WHEN unicode((doc_id || ':' || run)[i]) < 128 THEN [unicode((doc_id || ':' || run)[i])::BIGINT]
    ELSE [192 + unicode((doc_id || ':' || run)[i]) // 64, 128 + unicode((doc_id || ':' || run)[i]) % 64] END)) AS b
  FROM counted),
hashed AS (
  SELECT run, size, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256))) AS h
  FROM bytes, table_256),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % size] || run[h % size + 2:] ELSE run END AS word, k FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM damaged WHERE len(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, len(word) AS size, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM v)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.size = b.size AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN v b ON a.rest = b.word),
near AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-x.n, b)) AS top, max(x.n) AS top_n
  FROM pairs JOIN v x ON x.word = b GROUP BY a),
form AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * v.n THEN top END AS form, CASE WHEN top_n >= 10 * v.n THEN top_n END AS form_n
  FROM v LEFT JOIN near USING (word)),
chain(word, root, onward) AS (
  SELECT word, word, form FROM form
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN form f ON f.word = c.onward)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM form f JOIN chain c ON c.word = f.word AND c.onward IS NULL
"""
