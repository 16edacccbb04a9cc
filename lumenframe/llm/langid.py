"""Language identification: multinomial naive Bayes over hashed character n-grams.

Executors count n-grams of whole training texts; Spark sums the counts; the matrix of
log-probabilities, languages x BUCKETS, is broadcast.  A batch of texts becomes a sparse
matrix in coordinate form, a row number and a bucket for each n-gram, whose product with
the log-probabilities gives the scores of all its rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, fold

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 14
#: Training texts are a sample of at most about this many, the same share of it for each
#: language (by a hash of the text's id), so that a rare language keeps its texts.
MAX_TRAINING = 200_000
#: The languages that a model may hold; more than that is an error.
MAX_LANGUAGES = 512
PSEUDO_COUNT = 0.5
UNKNOWN = "und"
#: Texts are worked on together up to so many characters; a longer one is alone.
TOGETHER = 200_000

_SPACE, _APART = np.uint32(32), np.uint32(0x110000)


@lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    """Whether a code point is a letter; _APART, which is none, comes last."""
    return np.array([chr(c).isalpha() for c in range(0x110000)] + [False])


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: code points, in which a run of other characters than letters
    is one space and texts begin and end with one; the number of each point's text; and
    whether a text has a letter.  _APART lies between texts."""
    raw = np.frombuffer("".join(f" {x.lower()} \x00" for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x.lower()) + 3 for x in texts])
    ends = np.cumsum(sizes) - 1
    letter = _alphabetic()[raw]
    points = np.where(letter, raw, _SPACE)
    points[ends] = _APART
    row = np.repeat(np.arange(len(texts)), sizes)
    first = np.append(True, points[:-1] != _SPACE)
    keep = (points != _SPACE) | first
    return points[keep].astype(np.uint64), row[keep], np.bincount(row, letter, len(texts)) > 0


def sparse_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' n-grams as coordinates: row numbers and buckets; and whether each text
    has a letter."""
    points, row, has_letter = _points(texts)
    rows, buckets = [], []
    apart = points == _APART
    hashed, broken = np.zeros(len(points), np.uint64), np.zeros(len(points), bool)
    for order in range(1, max(ORDERS) + 1):
        n = len(points) - order + 1
        if n <= 0:
            break
        hashed = hashed[:n] * np.uint64(0x9E3779B97F4A7C15) + points[order - 1 :] + np.uint64(order)
        broken = broken[:n] | apart[order - 1 :]
        if order in ORDERS:
            at = ((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(50)
            whole = ~broken
            rows.append(row[:n][whole])
            buckets.append(at[whole].astype(np.int64))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *buckets]), has_letter


def _together(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded length together, with the number of the first."""
    start, held, size = 0, [], 0
    for i, x in enumerate(texts):
        if held and size + len(x or "") > TOGETHER:
            yield start, held
            start, held, size = i, [], 0
        held.append(x or "")
        size += len(x or "")
    if held:
        yield start, held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            langs = part.column(0).to_pylist()
            for start, texts in _together(part.column(1).to_pylist()):
                names, code = np.unique(langs[start : start + len(texts)], return_inverse=True)
                row, bucket, has_letter = sparse_grams(texts)
                counted = has_letter[row]
                n = np.bincount(code[row[counted]] * BUCKETS + bucket[counted], minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, got in zip(names.tolist(), n, strict=True):
                    totals[name] = totals.get(name, 0) + got
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_training: int = MAX_TRAINING) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-priors, and log-probabilities (languages x BUCKETS).

    Learns from rows with a language and a text outside the held-out fold.  Repeated rows
    count as often as they stand; an empty table gives a model of no language."""
    rows = docs.where(~fold(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    priors = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(priors) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    each = max_training / max(1, len(priors))
    picked = F.lit(True)
    for lang, size in priors.items():
        if size > each:
            picked = F.when(F.col("lang") == lang, drawn(each / size, "id", "text")).otherwise(picked)
    counts = rows.where(picked).select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(priors)
    matrix = np.full((len(langs), BUCKETS), PSEUDO_COUNT)
    got = counts.toPandas()  # at most languages x BUCKETS rows
    if len(got):
        matrix[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), got["bucket"].to_numpy()] += got["n"].to_numpy()
    log_prob = np.log(matrix) - np.log(matrix.sum(axis=1, keepdims=True)) if len(langs) else matrix
    log_prior = np.log(np.array([priors[x] for x in langs], float)) - np.log(max(1, sum(priors.values())))
    return langs, log_prior, log_prob


def score_batch(texts: list[str], log_prior: np.ndarray, log_prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-scores (texts x languages) and whether each text has a letter."""
    row, bucket, has_letter = sparse_grams(texts)
    logs = np.empty((len(texts), len(log_prior)))
    for k in range(len(log_prior)):  # a column of the sparse matrix's product
        logs[:, k] = np.bincount(row, log_prob[k][bucket], len(texts))
    return logs + log_prior, has_letter


def predict(docs: DataFrame, model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: id, lang_pred, score (the winner's posterior).

    Null texts and texts without a letter get `und` and score 0; so does every text
    when no language was learnt.  Ties go to the first language by name.  Repeated rows
    get equal results; other columns are ignored, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, table = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                pred, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                for start, texts in _together(part.column(1).to_pylist()) if names else ():
                    logs, has_letter = score_batch(texts, prior, table)
                    best = logs.argmax(axis=1)
                    sure = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    for i in np.flatnonzero(has_letter):
                        pred[start + i], score[start + i] = names[best[i]], sure[i]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(id_col, text_col).mapInArrow(run, f"_id {kind}, lang_pred string, score double")
    return got.select(F.col("_id").alias(id_col), "lang_pred", "score")
