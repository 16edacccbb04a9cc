"""A corpus pipeline: toxic documents go, then exact and near copies, personal data is
pseudonymised, and what is left is packed into bins of equal capacity.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
Rows with null or repeated ids are documents like others; extra columns stay in all but
the last stage; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import exact_dedup, minhash, packing, pii, toxicity
from lumenframe.llm.common import blanks_removed, scratch_table, table, text_of, with_row_key
from lumenframe.llm.entries import TEST_KEY, pseudonym_key

#: Near copies share this percentage of their shingles; at 0.80 two sketches differ in
#: 9.6 of 64 positions on average, with a deviation of 2.9.
NEAR_PERCENT, NEAR_MISSES = 80, 23


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labels table; documents that it rejects go.  Null
    and empty texts get the model's base rate, which is below the threshold where toxic
    texts are few."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays, then the one with
    the smallest id; of equal rows one.  Null, empty and blank texts are one group."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.  Rows that repeat an id or have
    none are decided one by one; texts without words stay."""
    return minhash.drop_near_copies(docs, percent=NEAR_PERCENT, misses=NEAR_MISSES)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; n_chars, where it is not null, follows the new
    text.  Null texts stay null."""
    out = pii.pseudonymise(docs, pseudonym_key(spark, TEST_KEY))
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where it lies in which bin, and its text.  A null text is an
    empty piece; a table without sources has no conflicts of sources."""
    rows, key = with_row_key(docs)
    text = text_of("text")
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    placed = packing.pack_keyed(rows, key, F.char_length(text), source, F.xxhash64(blanks_removed(text)), [key, "doc_id"])
    last = F.greatest(F.ceil(F.char_length(text) / packing.CAPACITY) - 1, F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * packing.CAPACITY + 1, F.lit(packing.CAPACITY)))
    pieces = rows.select(key, F.posexplode(cut).alias("piece", "text"))
    return placed.join(pieces.withColumn("piece", F.col("piece").cast("long")), [key, "piece"]).select("doc_id", *placed.drop(key, "doc_id").columns, "text")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The classifier and the packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
