"""Joins whose hot keys are cut up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that holds more than one in so many rows is hot; fewer keys than that can be.
HOT_SHARE = 1_000
#: About so many rows are counted to find hot keys.
COUNTED_ROWS = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


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
