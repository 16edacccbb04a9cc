"""Exact dedup with a heavy-hitter split.

A mergeable Misra-Gries summary (Spark's approx_top_k sketch) names the digests
that may be frequent.  Their exact winners are computed with a map-side combine
and broadcast, at most `heavy` rows, so that rows of large groups are decided
where they are read.  All other digests belong to groups of bounded share and
are decided by an ordinary shuffle of slim rows: winners by a map-side combine, then a
join with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blanks_removed, fresh, scratch_table, text_of


def frequent_digests(rows: DataFrame, heavy: int, tracked: int, fan_in: int = 64) -> DataFrame:
    """At most `heavy` digests; every digest with more than 1/heavy of the rows is
    among them as long as tracked is several times heavy.  The sketches are merged
    in two levels, so that no task takes one sketch of each input partition.  The last
    level has a constant key: a task without rows must not make an empty sketch."""
    parts = rows.groupBy((F.spark_partition_id() % fan_in).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(text_sha256, {tracked})").alias("sketch")
    )
    merged = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    top = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {heavy})")).alias("top"))
    return top.where("top.count > 1").select(F.col("top.item").alias("text_sha256")).distinct()


def winner(id_col: str) -> F.Column:
    """Most code points first, then the smallest id; a null id comes last."""
    return F.min(F.struct((-F.col("n_points")).alias("n"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id")))


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", heavy: int = 128, tracked: int = 1024) -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty and blank texts form one group.  Rows that
    repeat an id share its decision.  A null id wins only in a group without any
    other; keep_id is then null and the row is kept.  Other columns are ignored,
    an empty table gives an empty result.
    """
    text = text_of(text_col)
    rows = scratch_table(
        docs.select(
            F.col(id_col),
            F.sha2(blanks_removed(text), 256).alias("text_sha256"),
            F.char_length(text).cast("long").alias("n_points"),
        ),
        "digests",
    )
    if rows.isEmpty():
        return rows.select(id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    names = frequent_digests(rows, heavy, tracked)
    known = scratch_table(
        rows.join(F.broadcast(names), "text_sha256").groupBy("text_sha256").agg(winner(id_col).alias("best"), F.count(F.lit(1)).alias("group_size")),
        "frequent",
    )
    decided = rows.join(F.broadcast(known), "text_sha256")
    # winners of all other digests are combined before the shuffle; their join streams the
    # rows of a group past its one winner, so that no task holds a group
    light = rows.join(F.broadcast(known.select("text_sha256")), "text_sha256", "left_anti")
    winners = light.groupBy("text_sha256").agg(winner(id_col).alias("best"), F.count(F.lit(1)).alias("group_size"))
    rest = light.join(winners.hint("merge"), "text_sha256")
    return (
        decided.select(id_col, "text_sha256", "best", "group_size")
        .unionByName(rest.select(id_col, "text_sha256", "best", "group_size"))
        .select(
            F.col(id_col),
            F.col("best.id").alias("keep_id"),
            F.col("group_size"),
            F.col("best.id").eqNullSafe(F.col(id_col)).alias("kept"),
            F.col("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each group of equal texts; all columns stay.

    The row that exact_groups keeps stays.  Rows that share an id (or have none) are told
    apart by their texts; of rows equal in both, one of the longest stays."""
    text, here = text_of(text_col), [fresh(docs, "_id"), fresh(docs, "_sha256")]
    groups = scratch_table(exact_groups(docs, text_col, id_col).select(F.col(id_col).alias(here[0]), F.col("text_sha256").alias(here[1]), "kept"), "groups")
    same = F.col(id_col).eqNullSafe(F.col(here[0])) & (F.sha2(blanks_removed(text), 256) == F.col(here[1]))
    left = docs.join(groups.where("not kept").drop("kept").distinct(), same, "left_anti")
    twins = scratch_table(groups.where("kept").groupBy(*here).count().where("count > 1").select(*here), "twins")
    if twins.isEmpty():
        return left
    number, best = fresh(docs, "_number"), fresh(docs, "_best")
    numbered = scratch_table(left.join(twins, same, "left_semi").withColumn(number, F.monotonically_increasing_id()), "numbered")
    order = F.struct(-F.char_length(text), F.col(number))
    first = numbered.groupBy(F.col(id_col), F.sha2(blanks_removed(text), 256)).agg(F.min_by(number, order).alias(best)).select(best)
    one = numbered.join(first, F.col(number) == F.col(best), "left_semi").drop(number)
    return left.join(twins, same, "left_anti").unionByName(one)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
