"""Shared pieces: scratch tables, row keys, joins with hot keys, null-safe text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import _WRITTEN, drop_scratch, scratch_table  # noqa: F401  used by the operators and tests

#: The white space that the contracts name: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: A key that holds more than one in so many rows is hot; fewer keys than that can be.
HOT_SHARE = 1_000
#: About so many rows are counted to find hot keys.
COUNTED_ROWS = 1_000_000


def with_row_key(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a column that is different in every row, and its name: the id itself, or
    where that is null or repeated, a number beyond all ids.  Where ids are no integers,
    or leave no room above them, every row gets a number.  Numbers are written down, so
    that they are the same whenever they are read."""
    key = fresh(docs, "row_key")
    number = F.monotonically_increasing_id()
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return scratch_table(docs.withColumn(key, number), "numbered"), key
    id_ = F.col(id_col).cast("long")
    counted = docs.groupBy(id_.alias("odd_id")).count()
    odd = scratch_table(counted.where("count > 1 or odd_id is null").select("odd_id"), "odd_ids")
    if odd.isEmpty():
        return docs.withColumn(key, id_), key
    above = docs.agg(F.coalesce(F.max(id_), F.lit(-1)) + 1).first()[0] if docs.where(id_ > 1 << 61).isEmpty() else None
    if above is None:
        return scratch_table(docs.withColumn(key, number), "numbered"), key
    odd = odd.withColumnRenamed("odd_id", fresh(docs, "odd_id"))
    same = id_.eqNullSafe(F.col(odd.columns[0]))
    keyed = docs.join(odd, same, "left_semi").withColumn(key, F.lit(max(0, above)).cast("long") + number)
    return docs.join(odd, same, "left_anti").withColumn(key, id_).unionByName(scratch_table(keyed, "odd_rows")), key


def split_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner", counted: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Equi-join of left with right on the columns `on`, by a shuffle whose hot keys are cut up.

    A key with more than 1 / HOT_SHARE of left's rows is dealt into as many parts as it
    holds such shares, by a hash of spread; right's rows of that key go to every part.
    Fewer than HOT_SHARE keys can be hot, and their parts are fewer than twice that, so
    that their table is broadcast.  counted is a table with left's keys that is cheap to
    read (left itself by default), rows its size or a bound of it; of a large one, the
    rows of a hash share are counted, as only the load depends on it, never the result.
    Null keys meet nothing.  how is inner, left or left_semi."""
    counted = left if counted is None else counted
    rows = counted.count() if rows is None else rows
    every = max(1, rows // COUNTED_ROWS)
    part, parts = fresh(left, "_part"), fresh(left, "_parts")
    some = counted.where(F.pmod(F.xxhash64(spread), F.lit(every)) == 0) if every > 1 else counted
    named = [f"_k{i}" for i in range(len(on))]
    counts = some.groupBy(*[F.col(c).alias(k) for c, k in zip(on, named, strict=True)]).agg((F.count(F.lit(1)) * (every * HOT_SHARE / max(1, rows))).alias("_shares"))
    hot = F.broadcast(counts.where("_shares > 1").select(*named, F.ceil("_shares").cast("int").alias(parts)))

    def marked(df: DataFrame) -> DataFrame:
        same = [df[c] == hot[k] for c, k in zip(on, named, strict=True)]
        met = df.join(hot, same, "left")
        return met.select(*[df[c] for c in df.columns], F.coalesce(hot[parts], F.lit(1)).alias(parts))

    one = marked(left).withColumn(part, F.pmod(F.xxhash64(spread), F.col(parts)).cast("int")).drop(parts)
    other = marked(right).withColumn(part, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return one.join(other.hint("merge"), [*on, part], how).drop(part)


def text_of(col: str | Column) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def blanks_removed(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def fold(doc_id: Column) -> Column:
    """True for the held-out quarter: crc32 of the id as text, mod 4, is 2.

    A null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def drawn(share: float, *cols: str | Column) -> Column:
    """True for about that share of rows, chosen by a 64-bit hash of cols."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*cols) < F.lit(int(share * 2**64) - 2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
