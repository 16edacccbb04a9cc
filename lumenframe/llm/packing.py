"""Conflict-constrained best-fit packing.

Documents are dealt by a hash into groups of about GROUP rows, each packed by itself,
so that a run with more data has more groups of the same size.  In a group, pieces go
from the largest to the smallest into the bin with the least sufficient room that holds
neither their source nor their duplicate cluster yet.  Bins are ordered by their room;
the search starts at the first that is large enough and goes on to its successors until
one is compatible.  Each bin carries a bitmap of sources and one of clusters.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_row_key

CAPACITY = 8_192
GROUP = 4_096


class _Bins:
    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[tuple[int, int]] = []  # room, bin; ordered
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece whose conflicts are given as bits."""
        at = bisect_left(self.rooms, (size, -1))
        while at < len(self.rooms):
            room, b = self.rooms[at]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del self.rooms[at]
                break
            at += 1
        else:
            room, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if room > size or not size:
            insort(self.rooms, (room - size, b))
        return b, self.capacity - room


def pack_rows(rows: list[tuple], capacity: int) -> list[tuple]:
    """rows: (key, size, source, cluster).  Gives (row number, piece, start, size, bin,
    offset) of every piece; a text longer than the capacity is cut into full pieces and
    a rest, an empty one is a piece of size 0."""
    pieces = []
    for r, (_, size, _, _) in enumerate(rows):
        for k in range(max(1, -(-size // capacity))):
            pieces.append((min(capacity, size - k * capacity), r, k))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    numbers: tuple[dict, dict] = {}, {}

    def bit(kind: int, value) -> int:
        known = numbers[kind]
        return 0 if value is None else 1 << known.setdefault(value, len(known))

    bins = _Bins(capacity)
    out = []
    for size, r, k in pieces:
        b, offset = bins.put(size, bit(0, rows[r][2]), bit(1, rows[r][3]))
        out.append((r, k, k * capacity, size, b, offset))
    return out


_PLACED = "piece long, start long, size long, bin_id long, bin_at long, bin_free long"


def pack_keyed(docs: DataFrame, key: str, size: Column, source: Column, cluster: Column, keep: list[str], capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Per piece: the columns `keep` of its row, piece, start, size, bin_id, bin_at,
    bin_free (room left in the end).  key is a column of integers that differ in every
    row; ties in size follow it."""
    names = [f"_kept{i}" for i in range(len(keep))]
    slim = docs.select(
        F.col(key).cast("long").alias("_key"), F.coalesce(size.cast("long"), F.lit(0)).alias("_size"), source.cast("string").alias("_source"), cluster.cast("string").alias("_cluster"),
        *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
    )
    groups = max(1, -(-docs.count() // group))
    dealt = slim.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups)))

    def pack_group(number: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("_key").combine_chunks()
        rows = list(zip(*(t[c].to_pylist() for c in ("_key", "_size", "_source", "_cluster")), strict=True))
        placed = pack_rows(rows, capacity)
        used: dict[int, int] = {}
        for p in placed:
            used[p[4]] = used.get(p[4], 0) + p[3]
        base = number[0].as_py() << 24
        made = [(k, start, s, base + b, offset, capacity - used[b]) for _, k, start, s, b, offset in placed]
        kept = t.select(names).take(pa.array([p[0] for p in placed]))
        for n, c in zip(_PLACED.split(", "), zip(*made, strict=True), strict=True):
            kept = kept.append_column(n.split()[0], pa.array(c, pa.int64()))
        return kept

    kinds = "".join(f"{n} {slim.schema[n].dataType.simpleString()}, " for n in names)
    out = dealt.groupBy("_group").applyInArrow(pack_group, kinds + _PLACED)
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def pack(docs: DataFrame, size: Column, source: Column, cluster: Column, id_col: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Per piece: id, piece, start, size, bin_id, bin_at, bin_free (room left in the end).

    A null source or cluster conflicts with nothing; a null size counts as 0.  Rows that
    repeat an id, have none, or are equal in all columns are packed as separate
    documents, and dealt to any group.  Ties in size follow the id, rows without an id of
    their own last.  No document is dropped; an empty table gives an empty result.
    """
    rows, key = with_row_key(docs, id_col)
    return pack_keyed(rows, key, size, source, cluster, [id_col], capacity, group)
