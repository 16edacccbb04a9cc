"""Toxicity: a logistic classifier with a counterfactual penalty.

Features are the distinct words of a text, lower-cased, and their prefixes, hashed.
The classifier is fitted on a bounded sample of labelled rows.  Each labelled text gets a
copy in which neutral mentions are swapped for others of the same slot; the loss
penalises the difference of the two scores, so that a mention itself does not count.
Neutral mentions are terms that name groups (a fixed list) and, as the sample tells, the
words that many texts without toxicity hold.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drawn, fold, fresh, scratch_table

#: Terms that name groups; each row is one slot whose terms are swapped.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"),
)
#: Neutral words found in the sample: in this share of the texts without toxicity at
#: least, and in toxic ones no more than so many times as often; the most frequent ones,
#: SLOT of them to a slot.
NEUTRAL_SHARE, NEUTRAL_RATIO, MAX_NEUTRAL, SLOT = 0.02, 4.0, 512, 4

BITS = 22
MASK = (1 << BITS) - 1
PREFIXES = (3, 4, 5, 6, 7)
#: At most about this many labelled texts of each class are learnt from.
MAX_PER_CLASS = 6_000
#: Tasks that the sample is dealt to: the tables' own partitions hold few of its rows each.
SAMPLE_PARTS = 32
#: Features kept: those that differ most between the classes.
MAX_FEATURES = 4_096
L2, COUNTERFACTUAL, STEPS, RATE = 2e-4, 5.0, 300, 0.3
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _features_of_word(word: str) -> list[int]:
    """Hashed ids of the word and its prefixes."""
    made = [word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)]
    return [(zlib.crc32(x.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 >> 40) & MASK for x in made]


def features(words: set[str]) -> np.ndarray:
    return np.array(sorted({f for w in words for f in _features_of_word(w)}), np.int32)


def swaps(neutral: list[str] = []) -> dict[str, str]:  # noqa: B006  it is only read
    """For each term of a slot, the next one of it.  Slots are the fixed rows, then runs
    of the neutral words, in their order."""
    listed = {w for row in IDENTITY_TERMS for w in row}
    words = [w for w in neutral if w not in listed]
    slots = [*IDENTITY_TERMS, *(words[i : i + SLOT] for i in range(0, len(words), SLOT))]
    return {w: row[(i + 1) % len(row)] for row in slots for i, w in enumerate(row)}


def swapped(words: set[str], to: dict[str, str]) -> set[str] | None:
    """The words with every neutral mention replaced; None if there is none."""
    return {to.get(w, w) for w in words} if any(w in to for w in words) else None


class Model:
    """Sorted feature ids, their weights, and the intercept."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias = ids, weights, bias
        self.of = dict(zip(ids.tolist(), weights.tolist(), strict=True))
        self.known: dict[str, list[int]] = {}  # of a word, the features that count

    def __reduce__(self):
        return Model, (self.ids, self.weights, self.bias)

    def score(self, text: str | None) -> float:
        known, found = self.known, set()
        if len(known) > 300_000:
            known.clear()
        for w in words_of(text):
            at = known.get(w)
            if at is None:
                at = known[w] = [f for f in _features_of_word(w) if f in self.of]
            if at:
                found.update(at)
        z = self.bias + sum(self.of[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def train(rows: list[np.ndarray], ids: np.ndarray, labels: np.ndarray, twins: dict[int, np.ndarray], weights: np.ndarray, counterfactual: float = COUNTERFACTUAL) -> Model:
    """rows: places in ids of each text's features; twins: those of the swapped text, by
    row.  Full gradients with a rate for each weight (Adagrad), so that equal input
    gives an equal model."""
    if not len(rows) or labels.min() == labels.max():
        p = (weights @ labels + 0.5) / (weights.sum() + 1) if len(rows) else 0.0
        return Model(np.empty(0, np.int32), np.empty(0), float(np.log(p / (1 - p)) if 0 < p < 1 else -5.0))

    def flat(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(of)), [len(x) for x in of]), np.concatenate([np.empty(0, np.int64), *of])

    row, col = flat(rows)
    of_twin = np.array(sorted(twins), int)
    trow, tcol = flat([twins[i] for i in of_twin])
    w, bias, total = np.zeros(len(ids)), 0.0, weights.sum()
    speed, speed_b = np.full(len(ids), 1e-8), 1e-8
    y = labels.astype(float)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)) + bias, -30, 30)))
        err = weights * (p - y) / total
        grad_b = err.sum()
        grad = np.bincount(col, err[row], len(ids)) + L2 * w
        if len(of_twin) and counterfactual:
            q = 1 / (1 + np.exp(-np.clip(np.bincount(trow, w[tcol], len(of_twin)) + bias, -30, 30)))
            p0 = p[of_twin]
            gap = 2 * counterfactual * (p0 - q) * weights[of_twin] / total
            back = np.zeros(len(rows))
            back[of_twin] = gap * p0 * (1 - p0)
            grad += np.bincount(col, back[row], len(ids)) - np.bincount(tcol, (gap * q * (1 - q))[trow], len(ids))
            grad_b += back.sum() - (gap * q * (1 - q)).sum()
        speed += grad * grad
        speed_b += grad_b * grad_b
        w -= RATE * grad / np.sqrt(speed)
        bias -= RATE * grad_b / np.sqrt(speed_b)
    return Model(ids, w, float(bias))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[label].update(words_of(text.as_py()))
    words = list({**counts[0], **counts[1]})
    for at in range(0, len(words), 50_000):
        part = words[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[w] for w in part], pa.int64()) for c in counts)], names=["word", "n0", "n1"])


def neutral_words(sample: DataFrame, n0: int, n1: int) -> list[str]:
    """At most MAX_NEUTRAL words of sample(label, text), the most frequent first."""
    known = sample.mapInArrow(_word_counts, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share0, share1 = F.col("n0") / max(1, n0), F.col("n1") / max(1, n1)
    known = known.where((F.col("n0") >= 3) & (share0 >= NEUTRAL_SHARE) & (share1 <= NEUTRAL_RATIO * share0))
    return [r.word for r in known.orderBy(F.col("n0").desc(), "word").limit(MAX_NEUTRAL).collect()]


_FEATURES = "label int, f array<int>, twin array<int>"


def _extract(batches: Iterator[pa.RecordBatch], to: dict[str, str]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int32())
    for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
        words = [words_of(x.as_py()) for x in batch.column(1)]
        twins = [swapped(w, to) for w in words]
        f = [features(w) for w in words]
        t = [None if w is None else features(w) for w in twins]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, kind), pa.array(t, kind)], names=["label", "f", "twin"])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for label, f in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[label][f.values.to_numpy()] += 1  # ids of a row are distinct
    used = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(used), 100_000):
        x = used[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (x, counts[0][x], counts[1][x])], names=["feature", "d0", "d1"])


def chosen_features(found: DataFrame, n0: int, n1: int) -> np.ndarray:
    """At most MAX_FEATURES ids, sorted: those whose shares in the classes differ most, by
    three standard errors at least."""
    d = found.select("label", "f").mapInArrow(_feature_counts, "feature long, d0 long, d1 long").groupBy("feature").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    d = d.where(F.col("d0") + F.col("d1") >= 3)
    share = (F.col("d0") + F.col("d1")) / (n0 + n1)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n0 + 1 / n1))
    d = d.withColumn("gap", F.abs(F.col("d1") / n1 - F.col("d0") / n0) / error).where("gap > 3")
    return np.array(sorted(r.feature for r in d.orderBy(F.col("gap").desc(), "feature").limit(MAX_FEATURES).collect()), np.int32)


def _narrow(batches: Iterator[pa.RecordBatch], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    def places(x) -> np.ndarray | None:
        return np.flatnonzero(np.isin(ids, x.values.to_numpy(), assume_unique=True)).astype(np.int32) if x.is_valid else None

    kind = pa.list_(pa.int32())
    for batch in batches:
        made = [pa.array([places(x) for x in batch.column(k)], kind) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["label", "f", "twin"])


def fit(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS, counterfactual: float = COUNTERFACTUAL
) -> Model:
    """Fits on labelled rows outside the held-out fold.

    Of each class, a hash of the id picks about max_per_class texts; each class's rows
    count as many as it has.  Executors extract and choose features; the driver gets at
    most MAX_FEATURES small numbers for each of those texts, however long they are.  Rows
    with null label or null id are not learnt from; repeated rows, and contradicting
    labels of one id, count as they stand.  Labels other than 0 and 1 are ignored."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~fold(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    picked = F.lit(False)
    for k, size in sizes.items():
        picked = F.when(F.col("label") == k, drawn(max_per_class / size, "_id")).otherwise(picked)
    # about 2 * max_per_class rows, a stated bound
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known.where(picked)), "_id")
    sample = scratch_table(texts.select("label", "_text").repartition(SAMPLE_PARTS), "sample")
    drawn_of = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(drawn_of) < 2:
        y = np.repeat(list(drawn_of), list(drawn_of.values())).astype(int)
        return train([np.empty(0, int)] * len(y), np.empty(0, np.int32), y, {}, np.ones(len(y)))
    n0, n1 = drawn_of[0], drawn_of[1]
    to = swaps(neutral_words(sample, n0, n1))
    found = scratch_table(sample.mapInArrow(partial(_extract, to=to), _FEATURES), "features")
    ids = chosen_features(found, n0, n1)
    got = found.mapInArrow(partial(_narrow, ids=ids), _FEATURES).toArrow()
    y = got["label"].to_numpy()
    flat = lambda col: [x.values.to_numpy().astype(np.int64) if x.is_valid else None for x in got[col]]
    weights = np.array([sizes[int(k)] / drawn_of[int(k)] for k in y], float)
    return train(flat("f"), ids, y, {i: t for i, t in enumerate(flat("twin")) if t is not None}, weights, counterfactual)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of scores, 0 to 1; null and empty texts get the intercept's.
    A column of that name is replaced; all others stay."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != out.lower() or c == text_col])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            made = pa.array([m.score(x.as_py()) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at or above the threshold; all columns stay."""
    mark = fresh(docs, "_toxicity")
    return score(docs, model, text_col, mark).where(F.col(mark) < threshold).drop(mark)
