"""Alignment of two tokenizers over the bytes of every text.

Rows are shuffled by their full text, so that each distinct text is tokenised and
aligned once, wherever its copies lie; its token pairs weigh as many documents as it has
copies.  Distinct texts are written in chunks of bounded size.  A chunk sends each of its
pairs once, with the number of documents that hold it; the corpus-wide counts come back
to the chunk the same way, so that neither side of the exchange grows with the
occurrences of a pair.  The measures of a text then go to all ids that carry it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode_text
from .common import scratch_table, split_join

#: Distinct texts of about so many bytes are one chunk; a longer text is one by itself.
CHUNK_BYTES = 8 << 20
#: Texts that go through the piece library in one call hold about so many characters.
BATCH_CHARS = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    visible Latin-1 characters stand for themselves, other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_level(path: str, pattern: str):
    """(encoder, byte length of each id) of a byte-level vocabulary in JSON whose ids are
    the ranks of its merges.  Special tokens are left out, so that their strings are text."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ()) if t.get("special")}
    byte_of = byte_alphabet()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


@lru_cache(maxsize=2)
def pieces(path: str):
    """(processor, bytes of each id) of a piece model: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    named = [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode("utf-8", "surrogatepass")
        for i in range(model.get_piece_size())
    ]
    return model, named


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A, the first token of B whose byte range overlaps its own, and
    the first behind them.  Ends are running byte counts of the same text."""
    first = np.searchsorted(ends_b, np.concatenate([[0], ends_a[:-1]]), "right")
    return first, np.searchsorted(ends_b, ends_a, "left") + 1


def groups_text(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
    """The ids of both sides, cut where both have a token end: a1,a2|b1;a3|b2,b3."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=False)
    cut_a, cut_b = np.searchsorted(ends_a, common, "right"), np.searchsorted(ends_b, common, "right")
    sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
    out, i, j = [], 0, 0
    for x, y in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
        out.append(",".join(sa[i:x]) + "|" + ",".join(sb[j:y]))
        i, j = x, y
    return ";".join(out)


class Aligner:
    """Aligns texts; one for each task."""

    def __init__(self, json_path: str, pattern: str, model_path: str) -> None:
        self.a, self.size_a = byte_level(json_path, pattern)
        self.b, self.bytes_b = pieces(model_path)
        self.size_b = np.array([len(x) for x in self.bytes_b])

    def align(self, text: str, ids_b: list[int]):
        """(ids of A, ids of B, ends of A, ends of B), or None where the bytes of the
        tokens are not those of a space and the text."""
        whole = b" " + text.encode("utf-8", "surrogatepass")
        b = np.array(ids_b, np.int64)
        ends_b = np.cumsum(self.size_b[b])
        if not len(b) or ends_b[-1] != len(whole) or b"".join([self.bytes_b[i] for i in ids_b]) != whole:
            return None
        a = encode_text(self.a, " " + text).astype(np.int64)
        ends_a = np.cumsum(self.size_a[a])
        return (a, b, ends_a, ends_b) if ends_a[-1] == len(whole) else None


_ALIGNED = "chunk long, text_key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, k array<int>"


def _chunk_ids() -> Iterator[int]:
    """Numbers that no other task gives."""
    from pyspark import TaskContext

    task = TaskContext.get()
    yield from range((task.partitionId() if task else 0) << 32, 1 << 62)


def align_texts(texts: DataFrame, json_path: str, pattern: str, model_path: str, digest: bool) -> DataFrame:
    """texts (text_key, text, copies; distinct) with chunk, lengths, groups, and the
    distinct linked pairs a, b with k, the number of links of each."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(json_path, pattern, model_path)
        numbers = _chunk_ids()
        chunk, held = next(numbers), 0
        for batch in batches:
            at = 0
            texts = batch.column(1)
            while at < batch.num_rows:
                some, chars = [], 0
                while at + len(some) < batch.num_rows and (not some or chars < BATCH_CHARS):
                    some.append(texts[at + len(some)].as_py())
                    chars += len(some[-1])
                rows = []
                for text, ids_b in zip(some, aligner.b.encode(some, num_threads=1), strict=True):
                    if held and held + len(text) > CHUNK_BYTES:
                        chunk, held = next(numbers), 0
                    held += len(text)
                    got = aligner.align(text, ids_b)
                    if got is None:
                        rows.append((chunk, 0, 0, 0, 0, "", [], [], []))
                        continue
                    a, b, ends_a, ends_b = got
                    first, behind = overlaps(ends_a, ends_b)
                    n = behind - first
                    links_a = np.repeat(a, n)
                    links_b = b[np.arange(len(links_a)) + np.repeat(first - (np.cumsum(n) - n), n)]
                    pairs, k = np.unique((links_a << 32) | links_b, return_counts=True)
                    groups = groups_text(a, b, ends_a, ends_b)
                    n_groups = groups.count(";") + 1
                    if digest:
                        groups = hashlib.sha256(groups.encode()).hexdigest()
                    rows.append((chunk, len(a), len(b), n_groups, len(links_a), groups, pairs >> 32, pairs & 0xFFFFFFFF, k))
                cols = list(zip(*rows, strict=True))
                part = batch.slice(at, len(rows))
                lists = [pa.array(c, pa.list_(pa.int32())) for c in cols[6:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), part.column(0), part.column(2), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5], pa.string()), *lists],
                    names=[c.split()[0] for c in _ALIGNED.split(", ")],
                )
                at += len(rows)

    return texts.select("text_key", "text", "copies").mapInArrow(run, _ALIGNED)


def _pairs_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's pairs with the number of documents that hold them.  A chunk may go on
    in the next batch or, where a file was cut, in another task."""

    def summed(chunk: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        docs = np.bincount(at, np.concatenate([w for _, w in held]), len(pairs)).astype(np.int64)
        cols = [pa.array(np.full(len(pairs), chunk)), pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(docs)]
        return pa.RecordBatch.from_arrays(cols, names=["chunk", "a", "b", "docs"])

    last, held, size = None, [], 0
    for batch in batches:
        for chunk, copies, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if held and (chunk != last or size > 8_000_000):
                yield summed(last, held)
                held, size = [], 0
            last = chunk
            pairs = (a.values.to_numpy().astype(np.int64) << 32) | b.values.to_numpy().astype(np.int64)
            if len(pairs):
                held.append((pairs, np.full(len(pairs), copies, np.float64)))
                size += len(pairs)
    if held:
        yield summed(last, held)


def _measure(counts: pa.Table, texts: pa.Table) -> pa.Table:
    """Of one chunk: counts (a, b, count, best) and its texts, to their measures."""
    keys = (counts["a"].to_numpy().astype(np.int64) << 32) | counts["b"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    keys, count, best = keys[order], counts["count"].to_numpy()[order], counts["best"].to_numpy()[order]
    n_best, count_sum = [], []
    for a, b, k in zip(texts["a"], texts["b"], texts["k"], strict=True):
        at = np.searchsorted(keys, (a.values.to_numpy().astype(np.int64) << 32) | b.values.to_numpy().astype(np.int64))
        k = k.values.to_numpy().astype(np.int64)
        n_best.append(int(k[count[at] == best[at]].sum()))
        count_sum.append(int((k * count[at]).sum()))
    return pa.table([texts["text_key"], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=["text_key", "n_best", "count_sum"])


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, json_path: str, pattern: str, model_path: str, text_col: str = "text", id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Per row of docs: its id, MEASURES, and groups, the ids of both tokenizers cut where
    both have a token end, as `a1,a2|b1;a3|b2,b3` (with digest, its sha256 in lowercase hex).

    A is a byte-level vocabulary in JSON that encodes a space and the text, each match of
    pattern by itself; B a piece model that adds the space itself.  A link is a pair of
    tokens whose byte ranges overlap; a pair of ids counts the rows of docs that hold it
    linked.  n_best counts the links whose pair has the highest count among those of its
    A id (ties included), count_sum adds the counts of all links.

    Texts that are null, empty, or whose tokens do not give back the space and the text
    have zeros and empty groups.  Rows that repeat an id or lack one are rows like any
    other; equal rows count each.  Other columns are ignored; an empty table gives an
    empty result."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    filled = rows.where("text <> ''")
    # the text itself is the key of the shuffle; its digest names it afterwards
    texts = filled.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(F.unhex(F.sha2("text", 256)).alias("text_key"), "text", "copies")
    aligned = scratch_table(align_texts(texts, json_path, pattern, model_path, digest), "aligned")
    held = scratch_table(aligned.where("n_links > 0").select("chunk", "copies", "a", "b").mapInArrow(_pairs_of_chunks, "chunk long, a int, b int, docs long"), "chunk_pairs")
    counts = held.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    counts = scratch_table(counts, "pair_counts")
    # one row for each id of A's vocabulary at most
    best = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("best")))
    back = split_join(held.select("chunk", "a", "b"), counts, ["a", "b"], F.col("chunk")).join(best, "a")
    measured = (
        back.groupBy("chunk")
        .cogroup(aligned.where("n_links > 0").select("chunk", "text_key", "a", "b", "k").groupBy("chunk"))
        .applyInArrow(_measure, "text_key binary, n_best long, count_sum long")
    )
    found = aligned.select("text_key", "n_a", "n_b", "n_groups", "n_links", "groups").join(measured.hint("merge"), "text_key", "left")
    keyed = rows.select("id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("text_key"))
    met = split_join(scratch_table(keyed, "text_keys"), found, ["text_key"], F.xxhash64("id"), "left")
    return met.select(F.col("id").alias(id_col), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES), F.coalesce("groups", F.lit("")).alias("groups"))
