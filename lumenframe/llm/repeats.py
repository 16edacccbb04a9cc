"""Removal of repeated passages: suffix arrays of shards that hold all equal windows.

A window is width bytes of a text.  Its anchor is the run of m bytes inside it with the
least hash, so equal windows have equal anchors.  Successive windows with one anchor
make a segment; segments are dealt into shards by their anchor, and a window meets every
equal one there.  An anchor that occurs once in the corpus cannot hold a repeat, so only
segments of repeated anchors are cut out of the texts.  Equal segments are merged first
(all but the earliest repeat it); of the others, a shard sorts the suffixes by inducing
and finds equal windows by common prefixes.  An anchor with many different segments, such
as a phrase in many contexts, is dealt again by longer anchors, in the end by whole
windows, so that no shard grows with one phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, drawn, fresh, scratch_table, split_join, with_row_key
from .shingles import mix
from .suffixes import repeats

WIDTH = 100
#: Bytes of an anchor, as parts of the width; the last is the whole window.
ANCHORS = (0.32, 0.64, 1.0)
#: An anchor with more different segments is dealt again by longer ones.
MANY = 2_000
#: A shard array holds about so many bytes.
SHARD_BYTES = 1 << 20
#: Hot anchors come from this many rows.  They only spread the load.
COUNTED_DOCS = 20_000
_PLACE_BITS = 18
#: A segment has at most so many windows (texts of one byte would make endless ones).
LONGEST = 4096

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(np.arange(1, 80, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def _rolling(raw: np.ndarray, m: int) -> np.ndarray:
    """A hash of each run of m bytes, joined from runs of powers of two."""
    power, out, done, size = _BYTES[raw], None, 0, 1
    while size <= m:
        if m & size:
            if out is None:
                out, done = power, size
            else:
                keep = len(raw) - done - size + 1
                out = out[:keep] * _FACTORS[64 + size.bit_length()] + power[done : done + keep]
                done += size
        size *= 2
        if size <= m:
            half = size // 2
            power = power[: len(raw) - size + 1] * _FACTORS[size.bit_length()] + power[half : half + len(raw) - size + 1]
    return mix(out)


def anchored(raw: np.ndarray, m: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of raw (at most 2 ** _PLACE_BITS bytes): the hash of its anchor and
    the anchor's place, the first one if several are least."""
    h = _rolling(raw, m)
    bits = np.uint64((1 << _PLACE_BITS) - 1)
    least = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
    reach, span = width - m + 1, 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(h) - reach + 1], least[reach - span :])
    place = (least & bits).astype(np.int64)
    return h[place], place


def segments(raw: np.ndarray, ends: np.ndarray, m: int, width: int) -> tuple[np.ndarray, ...]:
    """Segments of several texts that stand one behind the other in raw and end at ends:
    start in raw, number of windows, anchor's hash, and whether the segment holds its
    anchor twice (and may repeat itself)."""
    found = []
    step = (1 << _PLACE_BITS) - width + 1
    for at in range(0, max(0, len(raw) - width + 1), step):
        part = raw[at : at + step + width - 1]
        key, place = anchored(part, m, width)
        n = len(key)
        # the first text that ends behind the window's start must reach to its end
        inside = ends[np.searchsorted(ends, np.arange(at, at + n), "right")] >= np.arange(at + width, at + n + width)
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | ~inside[1:] | ~inside[:-1]
        count = np.arange(n)
        start = np.maximum.accumulate(np.where(new, count, 0))
        new |= (count - start) % LONGEST == 0
        first = np.flatnonzero(new)
        stop = np.append(first[1:], n)
        ok = inside[first]
        first, stop = first[ok], stop[ok]
        found.append((first + at, stop - first, key[first].view(np.int64), place[first] != place[stop - 1]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and where each row ends; nulls are empty."""
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


_ANCHORED = "key long, row long, start int, n int, again boolean"


def _anchor(batches: Iterator[pa.RecordBatch], m: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            raw, ends = _bytes_of(part.column(1))
            start, n, key, again = segments(raw, ends, m, width)
            text = np.searchsorted(ends, start, "right")
            begin = np.concatenate([[0], ends[:-1]])
            row = part.column(0).to_numpy()[text]
            cols = [key, row, (start - begin[text]).astype(np.int32), n.astype(np.int32), again]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "row", "start", "n", "again"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those of keys with several rows, of hot keys (which have),
    and segments that hold their anchor twice."""
    held: pa.RecordBatch | None = None  # the last row, which is not decided yet
    before = None  # the key in front of it
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
        key = t.column(0).to_numpy()
        same = np.append(key[1:] == key[:-1], False)
        keep = same.copy()
        keep[1:] |= same[:-1]
        keep[0] |= before is not None and before == key[0]
        keep |= t.column(4).to_numpy(zero_copy_only=False) | (t.column(5).to_numpy() > 1)
        last = len(key) - 1
        yield t.slice(0, last).filter(pa.array(keep[:last])).drop_columns(["parts", "part"])
        held, before = t.slice(last), (key[last - 1] if last else before)
    if held is not None:
        keep = held.column(0)[0].as_py() == before or held.column(4)[0].as_py() or held.column(5)[0].as_py() > 1
        yield held.slice(0, int(keep)).drop_columns(["parts", "part"])


def repeated_anchors(docs: DataFrame, m: int, width: int) -> DataFrame:
    """The segments of docs (row, text) whose anchor is in another segment or twice in
    their own.  One shuffle by anchor; hot anchors are spread by row."""
    found = partial(_anchor, m=m, width=width)
    every = docs.mapInArrow(found, _ANCHORED)
    share = min(1.0, COUNTED_DOCS / max(1, docs.count()))
    counts = scratch_table(docs.where(drawn(share, "row")).mapInArrow(found, _ANCHORED).groupBy("key").count(), "anchor_counts")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    shares = F.col("count") * HOT_SHARE / max(1, total)
    # fewer than HOT_SHARE keys
    hot = F.broadcast(counts.where((shares > 1) & (F.col("count") > 1)).select("key", F.ceil(shares + 1).cast("int").alias("parts")))
    dealt = every.join(hot, "key", "left").select("key", "row", "start", "n", "again", F.coalesce("parts", F.lit(1)).alias("parts"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).repartition("key", "part").sortWithinPartitions("key")
    return dealt.mapInArrow(_repeated, _ANCHORED)


_MEMBER = "key long, row long, start int, n int, again boolean, twice boolean, seg binary"
_MEMBER_NAMES = ["key", "row", "start", "n", "again", "twice", "seg"]


def _members(rows: list[tuple], row_type=None) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_MEMBER_NAMES)


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Segments with their bytes, from rows of a text and its list of segments.  twice
    marks a segment that is equal to an earlier one of the same text."""
    out, size = [], 0
    for batch in batches:
        for row, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw, seen = text.as_py().encode("utf-8", "surrogatepass"), set()
            for s in sorted(found.as_py(), key=lambda s: s["start"]):
                seg = raw[s["start"] : s["start"] + s["n"] + width - 1]
                twice = (s["key"], seg) in seen
                seen.add((s["key"], seg))
                out.append((s["key"], row, s["start"], s["n"], s["again"], twice, b"" if twice else seg))
                size += len(seg)
                if size > 1 << 22:
                    yield _members(out)
                    out, size = [], 0
    if out:
        yield _members(out)


def _recut(batches: Iterator[pa.RecordBatch], m: int, width: int) -> Iterator[pa.RecordBatch]:
    """The same from segments (key, row, start, seg) by longer anchors."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            raw, ends = _bytes_of(part.column(3))
            begin = np.concatenate([[0], ends[:-1]])
            start, n, key, again = segments(raw, ends, m, width)
            of = np.searchsorted(ends, start, "right")
            key = mix(part.column(0).to_numpy().view(np.uint64)[of] ^ key.view(np.uint64)).view(np.int64)
            row = part.column(1).to_numpy()[of]
            place = part.column(2).to_numpy()[of] + (start - begin[of])
            whole, out, seen, last = raw.tobytes(), [], set(), None
            for k, r, p, c, g, s, o in zip(key.tolist(), row.tolist(), place.tolist(), n.tolist(), again.tolist(), start.tolist(), of.tolist(), strict=True):
                if o != last:
                    seen, last = set(), o
                seg = whole[s : s + c + width - 1]
                twice = (k, seg) in seen
                seen.add((k, seg))
                out.append((k, r, p, c, g, twice, b"" if twice else seg))
            yield _members(out)


_RANGE = "row long, start int, n int"


def _ranges(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["row", "start", "n"])


def shard_ranges(row: np.ndarray, start: np.ndarray, segs: list[bytes], width: int) -> pa.RecordBatch:
    """Windows of the segments of a shard that start earlier in another place there, as
    ranges of successive window starts.  Windows of one text lie in one segment each.

    The array is made of those windows only whose longer anchor is there twice."""
    order = np.lexsort((start, row))
    row, start, segs = row[order], start[order], [segs[i] for i in order.tolist()]
    raw = np.frombuffer(b"".join(segs), np.uint8)
    stops = np.cumsum([len(s) for s in segs])
    at, n, key, again = segments(raw, stops, max(1, int(width * ANCHORS[1])), width)
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    keep = (count[which] > 1) | again
    at, n = at[keep], n[keep]
    if not len(at):
        return _ranges(row[:0], start[:0], start[:0])
    of = np.searchsorted(stops, at, "right")
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + n[:-1]) | (of[1:] != of[:-1])  # parts that follow each other are one
    first = np.flatnonzero(new)
    n, at, of = np.add.reduceat(n, first), at[first], of[first]
    row, start = row[of], start[of] + at - np.concatenate([[0], stops[:-1]])[of]
    size = n + width  # with a separator behind each
    ends = np.cumsum(size)
    begin = ends - size
    place = np.arange(ends[-1]) - np.repeat(begin, size)
    text = np.append(raw, 0)[np.repeat(at, size) + place].astype(np.uint16) + np.uint16(2)
    text[ends - 1] = 1
    text = np.append(text, np.uint16(0))
    room = np.append(np.repeat(size - 1, size) - place, 0)
    found = repeats(text, room, width)
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1] + 1
    first = np.flatnonzero(new)
    of = np.searchsorted(ends, found[first], "right")
    return _ranges(row[of], start[of] + found[first] - begin[of], np.diff(np.append(first, len(found))))


def _shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows key, row, start, again, seg sorted by key: whole keys in shards of bounded size."""
    held, size = [], 0  # key, row, start, again, seg
    last, of_key, bytes_of_key = None, [], 0

    def shard() -> pa.RecordBatch:
        return shard_ranges(np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64), [h[4] for h in held], width)

    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if r[0] != last:
                if len(of_key) > 1 or of_key and of_key[0][3]:  # one segment alone repeats nothing
                    if held and size + bytes_of_key > SHARD_BYTES:
                        yield shard()
                        held, size = [], 0
                    held += of_key
                    size += bytes_of_key
                last, of_key, bytes_of_key = r[0], [], 0
            of_key.append(r)
            bytes_of_key += len(r[4]) + 1
    if len(of_key) > 1 or of_key and of_key[0][3]:
        held += of_key
    if held:
        yield shard()


def repeat_ranges(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, start, n of docs (row, text; row unique): n successive windows whose string
    also starts earlier, in a smaller row or further left in the same one."""
    sizes = [max(1, int(width * part)) for part in ANCHORS]
    hits = repeated_anchors(docs, sizes[0], width)
    lists = hits.groupBy("row").agg(F.collect_list(F.struct("key", "start", "n", "again")).alias("found"))
    members = docs.join(lists.hint("merge"), "row").select("row", "text", "found").mapInArrow(partial(_cut, width=width), _MEMBER)
    out = None
    for level, _ in enumerate(sizes):
        members = scratch_table(members, f"members_{level}")
        alone = members.where("not twice")
        firsts = alone.groupBy("key", "seg").agg(F.min("row").alias("row"), F.min_by("start", "row").alias("start"), F.bool_or("again").alias("again"))
        firsts = scratch_table(firsts.select("key", "row", "start", "again", "seg"), f"firsts_{level}")
        later = members.select("row", "start", "n").join(firsts.select("row", "start").hint("merge"), ["row", "start"], "left_anti")
        out = later if out is None else out.unionByName(later)
        if level + 1 < len(sizes):
            many = scratch_table(firsts.groupBy("key").count().where(F.col("count") > MANY).select("key"), f"many_{level}")
        else:
            many = None  # an anchor is a whole window: equal ones are merged already
        split = many is not None and not many.isEmpty()
        few = firsts.join(many, "key", "left_anti") if split else firsts
        dealt = few.repartition("key").sortWithinPartitions("key")
        out = out.unionByName(dealt.mapInArrow(partial(_shards, width=width), _RANGE))
        if not split:
            break
        hot = split_join(firsts, many, ["key"], F.col("row"), "left_semi").select("key", "row", "start", "seg")
        members = hot.mapInArrow(partial(_recut, m=sizes[level + 1], width=width), _MEMBER)
    return out


_KEPT = "n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def _keep(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, spans, kept = [], [], []
        for text, starts, sizes in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            n.append(len(raw))
            if not starts.is_valid or not len(starts):
                spans.append([])
                kept.append(raw)
                continue
            start = starts.values.to_numpy().astype(np.int64)
            change = np.bincount(start, minlength=len(raw) + 1) - np.bincount(start + sizes.values.to_numpy() + width - 1, minlength=len(raw) + 1)
            gone = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
            spans.append([{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["row", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Per row of docs: its id, n_bytes (of the text in UTF-8), spans (start, stop of the
    maximal runs of removed bytes) and kept (the other bytes).

    A byte goes if a string of width bytes covers it that also starts earlier: in a row of
    smaller id, or further left in the same row.  Overlaps count, strings never cross
    rows, and all are judged on the texts as given.  Null and empty texts have no bytes.
    Rows that repeat an id or lack one count as later than all others, in a fixed order
    of their own; ids that are no integers have no order, so that all rows count in such
    an order.  Other columns are ignored; an empty table gives an empty result."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, key = with_row_key(slim, "id")
    rows = rows.withColumnRenamed(key, "row")
    texts = rows.select("row", "text")
    ranges = repeat_ranges(texts.where(F.octet_length("text") >= width), width)
    lists = ranges.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
    kept = texts.join(lists.hint("merge"), "row", "left").select("row", "text", "starts", "sizes").mapInArrow(partial(_keep, width=width), f"row long, {_KEPT}")
    if key == "row_key" and rows.schema["id"].dataType == kept.schema["row"].dataType and rows.where("not (id <=> row)").isEmpty():
        return kept.withColumnRenamed("row", id_col)  # the key is the id itself
    return rows.select("row", "id").join(kept.hint("merge"), "row").drop("row").withColumnRenamed("id", id_col)


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS raw FROM documents),
w AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth
  FROM (SELECT doc_id, p, substring(raw, 2 * p + 1, 200) AS s FROM (SELECT doc_id, raw, unnest(range(length(raw) // 2 - 99)) AS p FROM d))),
r AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM w WHERE nth > 1),
covered AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM r GROUP BY doc_id, run),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM covered),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS span FROM marked),
spans AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM numbered GROUP BY doc_id, span),
holes AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substring(raw, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS front, max(b) AS tail
  FROM holes JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(d.raw) // 2 AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.front || substring(d.raw, 2 * k.tail + 1), d.raw))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
