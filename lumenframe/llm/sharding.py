"""Minimax contiguous partition of texts into shards.

Equal texts form an atomic group.  Groups are ordered by the digest of their text,
which needs no sort on a skewed key.  The smallest feasible shard capacity is found by
binary search; each trial fills shards greedily, and the cuts are where the greedy fill
of the smallest capacity ends its shards.

The driver never sees the groups, only prefix sums of buckets: all digests that begin
with the same hexadecimal digits.  A greedy step that ends inside a bucket is known
within bounds; the buckets in which such ends lie are then split by further digits, a few
hundred at a time, until capacity and cuts are exact.  A round is one Spark job, and each
divides the uncertain buckets by 256, so that a handful of rounds does for any corpus.
Rows find their shard by comparing their digest with the cuts, without a join.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_table, text_of

#: Hexadecimal digits of a digest that name a bucket at first, and by how many it is
#: split; at most so many buckets are split in a round.
FIRST_DIGITS, MORE_DIGITS, SPLITS = 3, 2, 256


class Buckets:
    """Prefix sums over the groups' sizes, at the resolution known so far."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        """rows: prefix, size, size of the largest group, number of groups."""
        self.rows = sorted(rows)
        self.starts = [0, *accumulate(r[1] for r in self.rows)]
        self.total = self.starts[-1]

    def at(self, position: int) -> int:
        return bisect_right(self.starts, position) - 1

    def known(self, position: int) -> bool:
        """Whether a group surely ends at the position."""
        return position >= self.total or self.starts[self.at(position)] == position

    def last_end(self, position: int) -> tuple[int, int]:
        """Bounds of the last group end that is not beyond the position."""
        if position >= self.total:
            return self.total, self.total
        b = self.at(position)
        start, (_, _, largest, groups) = self.starts[b], self.rows[b]
        if start == position or groups == 1:
            return start, start
        return max(start, position - largest + 1), position

    def fill(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of the ends of the shards that a greedy fill makes."""
        low = high = 0
        ends = []
        for _ in range(shards):
            low, high = self.last_end(low + capacity)[0], self.last_end(high + capacity)[1]
            ends.append((low, high))
        return ends

    def unsure(self, least: int, most: int, shards: int) -> list[str]:
        """Buckets of several groups in which a shard of some capacity from least to most
        may end, the largest first."""
        found: dict[int, int] = {}
        low = high = 0
        for _ in range(shards):
            low, high = low + least, high + most
            for b in range(self.at(low), min(self.at(high), len(self.rows) - 1) + 1):
                inside = max(low, self.starts[b] + 1) <= min(high, self.starts[b + 1] - 1)
                if inside and self.rows[b][3] > 1:
                    found[b] = self.rows[b][1]
            low, high = self.last_end(low)[0], self.last_end(high)[1]
        return [self.rows[b][0] for b in sorted(found, key=lambda b: (-found[b], b))]

    def split(self, parts: dict[str, list[tuple[str, int, int, int]]]) -> Buckets:
        return Buckets([r for row in self.rows for r in parts.get(row[0], [row])])


def _least(low: int, high: int, holds) -> int:
    """The least number from low to high for which holds; it holds for high."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle + 1, high)
    return low


def _sums(groups: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
    """Sums by the first digits of the digest: a bounded number of rows for the driver."""
    prefix = F.substring("digest", 1, digits).alias("prefix")
    got = groups.groupBy(prefix).agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("groups"))
    return [tuple(r) for r in got.collect()]


def minimax_cuts(groups: DataFrame, shards: int, splits: int = SPLITS) -> tuple[int, list[str]]:
    """The smallest feasible capacity, and the digest prefixes at which the shards after
    the first begin (None where a shard and those after it are empty).  groups(digest,
    size) are atomic and ordered by digest."""
    buckets = Buckets(_sums(groups, FIRST_DIGITS))
    if not buckets.total:
        return 0, [None] * (shards - 1)
    largest = max(r[2] for r in buckets.rows)
    while True:
        total = buckets.total
        floor = max(largest, -(-total // shards))
        ceiling = floor + largest  # every shard but the last then takes an even share at least
        most = _least(floor, ceiling, lambda c: c == ceiling or buckets.fill(c, shards)[-1][0] >= total)
        least = _least(floor, most, lambda c: buckets.fill(c, shards)[-1][1] >= total)
        ends = buckets.fill(most, shards)
        if least == most and all(low == high and buckets.known(low) for low, high in ends):
            starts = [low for low, _ in ends[:-1]]
            return most, [buckets.rows[buckets.at(x)][0] if x < total else None for x in starts]
        unsure = buckets.unsure(least, most, shards)[:splits]
        by_length: dict[int, list[str]] = {}
        for p in unsure:
            by_length.setdefault(len(p), []).append(p)
        parts: dict[str, list[tuple[str, int, int, int]]] = {p: [] for p in unsure}
        for digits, prefixes in by_length.items():
            inside = groups.where(F.substring("digest", 1, digits).isin(prefixes))
            for row in _sums(inside, digits + MORE_DIGITS):
                parts[row[0][:digits]].append(row)
        buckets = buckets.split(parts)


def shard_by_bytes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shards: int = 8, splits: int = SPLITS, slot_parts: int = 512) -> DataFrame:
    """Per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 1, null text as none.  Equal texts share
    a shard (null and empty text are equal); shards are contiguous in the order of
    text digests, and the largest is as small as that allows.  If one group is larger
    than an even share, the last shards may be empty.  slot counts the rows of a shard
    from 0; the order within a shard is by a hash of the row.  An empty table gives an
    empty result; repeated ids and null ids are rows like others.
    """
    text = text_of(text_col)
    rows = scratch_table(
        docs.select(
            F.col(id_col),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(text, 256).alias("digest"),
        ),
        "sizes",
    )
    groups = scratch_table(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    _, cuts = minimax_cuts(groups, shards, splits)
    shard = F.lit(0)
    for c in cuts:
        if c is not None:
            shard = shard + F.when(F.col("digest") >= c, 1).otherwise(0)
    part = F.pmod(F.xxhash64(id_col, "digest"), F.lit(slot_parts))
    placed = rows.select("*", shard.alias("shard"), part.alias("part"))
    counts = placed.groupBy("shard", "part").count()  # shards x slot_parts rows
    before = counts.select(
        "shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before")
    )
    return (
        placed.join(F.broadcast(before), ["shard", "part"])
        .withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("digest", id_col)))
        .select(
            F.col(id_col),
            F.col("size"),
            F.col("text_crc32"),
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
