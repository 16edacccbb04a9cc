"""MinHash near-dedup by an LSH forest.

Documents with equal shingle sets are one class.  Each class gets minhashes; each of
TREES sorted orders arranges the classes by another run of them.  In an order, classes
that share a prefix of hashes form a region.  Depth adapts to each region: at the
shallowest depth at which it is small, all its pairs are candidates; where it is
dense, a class meets its neighbours of longest common prefix and the region's centre,
the member nearest to the majority of the region's sketches (whatever else is close
there has a second way, below).  A region that a range
boundary cuts also asks for the class whose sketch is that majority, wherever it is.
So the number of candidates is linear in the number of classes, and a star of copies
around one original is found through its centre.  Candidates pass an exact test of
sizes and a lenient test of sketches, then the full sets decide.

In dense regions two classes may be linked to each other alone, for instance inside
common boilerplate.  A class in several of them (see COMMON_TREES) therefore also
meets others by its rarest shingles.  In any fixed order of all shingles, two sets of
the wanted similarity share one of their first shingles ("prefix"); rare ones come
first, so that boilerplate is not among them.  All pairs of a list of at most LIST
classes that share a prefix shingle are candidates at once.  A longer list is split by a
minhash of the rest of the prefix, another one for each list; where even that leaves
many, they meet their neighbours and the first.

What such a list leaves out follows when the links found so far have made components: in
every list of a shingle whose classes lie in several components, each class meets all of
the list in other components, in blocks of bounded size.  Most of a dense cluster is one
component by then, so that this is little; and no component stays split for the length
of a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_table, split_join, with_row_key
from .shingles import mix, shingle_set

TREES, DEPTH, SKETCH = 10, 9, 64
HASHES = TREES * DEPTH
SMALL = 9
#: Sketch positions in which two sets may differ.  At similarity 0.85 they differ in
#: 7.2 of 64 on average, with a deviation of 2.5.
MISSES = 18
PERCENT = 85
#: A class whose first hash in more than this many trees is shared by more than SMALL
#: classes also goes by its rare shingles.  With s of its shingles common to many, a
#: tree's first hash is one with chance s, and else a partner at 0.80 shares it with
#: (0.89 - s) / (1.11 - s): both together are below 2e-5 for a class that stays out.
COMMON_TREES = 2
#: Rows of sorted orders in one range partition, which a task holds (about 100 bytes each).
RANGE_ROWS = 200_000
LIST = 24
#: Classes of a list that meet in one task; a longer list is cut into pairs of blocks.
BLOCK = 8_192
#: The order of shingles comes from this many texts, counted in 2 ** COUNT_BITS buckets.
#: It is only an order: any one gives the same pairs, a good one short lists.
ORDER_TEXTS, COUNT_BITS = 16_384, 22

_KEY = 4 * DEPTH
_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima; the products are permutations of mixed hashes."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * _MULTIPLIERS).min(axis=0), out=low)
    return (mix(low) >> np.uint64(32)).astype(">u4")


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = shingle_set(text.as_py())
            if not len(s):
                rows.append((doc_id, 0, 0, 0, 0, 0, b""))
                continue
            h = minhashes(s)
            bits = np.stack([h[:SKETCH] & 1, (h[:SKETCH] >> 1) & 1]).astype(np.uint8)
            lo, hi = np.packbits(bits, axis=1).view(">u8").astype(np.int64).ravel()
            f1, f2 = _signed(np.array([mix(s + np.uint64(7)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5)))]))
            rows.append((doc_id, len(s), int(f1), int(f2), int(lo), int(hi), h.tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "n", "f1", "f2", "lo", "hi", "sig"])


def _misses(lo, hi, i, j) -> np.ndarray:
    return np.bitwise_count((lo[i] ^ lo[j]) | (hi[i] ^ hi[j]))


def neighbours(tree: np.ndarray, keys: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, cut_first: bool = True, cut_last: bool = True, percent: int = PERCENT, misses: int = MISSES):
    """Candidates among classes sorted by tree and key: index pairs, (index, lo, hi) of
    the centres that regions at a cut ask for, and the depth at which all pairs of a
    class's region are candidates (DEPTH + 1: at none)."""
    count = len(tree)
    lo, hi = lo.view(np.uint64), hi.view(np.uint64)
    same = np.zeros((count, DEPTH), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None]
    lcp = np.logical_and.accumulate(same, axis=1).sum(axis=1)  # with the row before
    small_at = np.full(count, DEPTH + 1)
    pairs_i, pairs_j, asks = [], [], []
    bits = None
    for d in range(1, DEPTH + 1):
        starts = np.flatnonzero(lcp < d)
        sizes = np.diff(np.append(starts, count))
        region = np.repeat(np.arange(len(starts)), sizes)
        small_at = np.where((sizes[region] <= SMALL) & (small_at > DEPTH), d, small_at)
        dense = np.flatnonzero(sizes > SMALL)
        if not len(dense):
            break
        if bits is None:
            bits = np.unpackbits(np.stack([lo, hi], axis=1).astype(">u8").view(np.uint8), axis=1)
        for r in dense:
            a, b = starts[r], starts[r] + sizes[r]
            votes = np.packbits(2 * bits[a:b].sum(axis=0, dtype=np.int64) > b - a).view(">u8").astype(np.uint64)
            off = np.bitwise_count((lo[a:b] ^ votes[0]) | (hi[a:b] ^ votes[1]))
            near = np.arange(a, b)[off <= 2 * misses]
            centre = a + int(np.argmin(off))
            pairs_i.append(near)
            pairs_j.append(np.full(len(near), centre))
            if (a == 0 and cut_first) or (b == count and cut_last):
                asks.append((near, votes))
    least = lcp.copy()  # of the rows up to the one j places on
    rows = np.arange(count)
    for j in range(1, SMALL):
        if count <= j:
            break
        least = np.minimum(least[: count - j], lcp[j:]) if j > 1 else lcp[1:]
        i = rows[: count - j]
        hit = least >= (1 if j <= 2 else np.minimum(small_at[i], DEPTH + 1))
        pairs_i.append(i[hit])
        pairs_j.append(i[hit] + j)
    i, j = (np.concatenate(x) if x else np.empty(0, int) for x in (pairs_i, pairs_j))
    keep = (i != j) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    keep &= _misses(lo, hi, i, j) <= misses
    region = np.cumsum(lcp < 1)
    cut = (cut_first & (region == region[:1])) | (cut_last & (region == region[-1:]))
    return i[keep], j[keep], asks, np.where(cut, DEPTH + 1, small_at)


#: Rows of candidates: a pair; a class that asks for a centre; or one that is doubtful.
_CANDIDATE = "a long, b long, lo long, hi long"


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, misses: int) -> Iterator[pa.RecordBatch]:
    got = list(batches)  # one range partition of slim rows
    names = _CANDIDATE.replace(" long", "").split(", ")
    if not got:
        return
    t = pa.Table.from_batches(got)
    if not len(t):
        return
    keys = np.frombuffer(b"".join(t["key"].to_pylist()), ">u4").reshape(len(t), DEPTH)
    tree, ids, n, lo, hi = (t[c].to_numpy() for c in ("tree", "id", "n", "lo", "hi"))
    i, j, asks, depth = neighbours(tree, keys, n, lo, hi, percent=percent, misses=misses)
    pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    for at in range(0, len(pairs), 50_000):
        p = pairs[at : at + 50_000]
        null = pa.nulls(len(p), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), null, null], names=names)
    for near, votes in asks:
        v = _signed(votes)
        for at in range(0, len(near), 50_000):
            x = ids[near[at : at + 50_000]]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64()), pa.array(np.full(len(x), v[0])), pa.array(np.full(len(x), v[1]))], names=names)
    deep = np.flatnonzero(depth > 1)
    for at in range(0, len(deep), 50_000):
        x = ids[deep[at : at + 50_000]]
        null = pa.nulls(len(x), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x), null, null, null], names=names)


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            np.add.at(counts, _buckets(shingle_set(text.as_py())), 1)
    used = np.flatnonzero(counts)
    for at in range(0, len(used), 100_000):
        x = used[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(counts[x])], names=["bucket", "k"])


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The rarest shingles, one of which a set of the wanted similarity shares, and how
    many of them suffice against sets that are not smaller."""
    n = len(shingles)
    order = np.lexsort((shingles, counts[_buckets(shingles)]))
    small = n - -(-2 * percent * n // (100 + percent)) + 1
    return shingles[order[: n - -(-percent * n // 100) + 1]], small


_LISTED = "part long, rest long, own boolean, id long, n long, lo long, hi long"


def _list(batches: Iterator[pa.RecordBatch], counts: np.ndarray, hot: int, percent: int) -> Iterator[pa.RecordBatch]:
    names = ["part", "rest", "own", "id", "n", "lo", "hi"]
    held: list[list[np.ndarray]] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    for batch in batches:
        for id_, n, lo, hi, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
            s = shingle_set(text.as_py())
            if len(s) != n:  # another text of a repeated id
                continue
            p, small = prefix(s, counts, percent)
            rest = np.zeros(len(p), np.uint64)
            for at in range(0, len(p) if len(p) > 1 else 0, 256):
                products = p[None, :] * (mix(p[at : at + 256, None]) | np.uint64(1))
                products[np.arange(len(products)), np.arange(at, at + len(products))] = np.iinfo(np.uint64).max
                rest[at : at + 256] = products.min(axis=1)
            rest = np.where(rest == 0, rest, mix(rest))
            part = np.where(counts[_buckets(p)] > hot, mix(p ^ rest), p)
            held.append([_signed(part), _signed(rest), np.arange(len(p)) < small, *(np.full(len(p), v, np.int64) for v in (id_, n, lo, hi))])
            rows += len(p)
            if rows >= 50_000:
                yield flush()
                held, rows = [], 0
    if held:
        yield flush()


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the run of equal keys in which each row lies."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(new)))
    return np.repeat(starts, sizes), np.repeat(sizes, sizes)


def list_pairs(part, rest, own, ids, n, lo, hi, percent: int, misses: int) -> np.ndarray:
    """Candidates (smaller id, larger id) among the rows of whole lists."""
    lo, hi = lo.view(np.uint64), hi.view(np.uint64)
    left, right = [], []

    def within(rows: np.ndarray, start: np.ndarray, size: np.ndarray, reach: int) -> None:
        for j in range(1, reach + 1):
            at = np.flatnonzero((start[j:] == start[:-j]) & (size[j:] > 1))
            if not len(at):
                break
            left.append(rows[at])
            right.append(rows[at + j])

    rows = np.lexsort((ids, n, part))
    start, size = _runs(part[rows])
    short = size <= LIST
    within(rows[short], start[short], size[short], LIST - 1)
    rows = rows[~short]
    if len(rows):
        rows = rows[np.lexsort((hi[rows], lo[rows], n[rows], rest[rows], part[rows]))]
        start, size = _runs(part[rows], rest[rows])
        short = size <= LIST
        within(rows[short], start[short], size[short], LIST - 1)
        first, rows = rows[start[~short]], rows[~short]
        within(rows, start[~short], size[~short], 2)
        left.append(first)
        right.append(rows)
    if not left:
        return np.empty((0, 2), np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    keep = own[i] & (ids[i] != ids[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    i, j = i[keep], j[keep]
    keep = _misses(lo, hi, i, j) <= misses
    i, j = ids[i[keep]], ids[j[keep]]
    return np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0)


def _meet(batches: Iterator[pa.RecordBatch], percent: int, misses: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def pairs(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(got)
        p = list_pairs(*(t[c].to_numpy() for c in ("part", "rest", "own", "id", "n", "lo", "hi")), percent, misses)
        for at in range(0, len(p), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(p[at : at + 50_000, 0]), pa.array(p[at : at + 50_000, 1])], names=["a", "b"])

    for batch in batches:  # sorted by part; a list may go on in the next batch
        if not len(batch):
            continue
        part = batch.column(0).to_numpy()
        done = int(np.searchsorted(part, part[-1]))
        if done or held and held[-1].column(0)[-1].as_py() != part[0]:
            yield from pairs([*held, batch.slice(0, done)])
            held = []
        held.append(batch.slice(done))
    if held:
        yield from pairs(held)


def shingle_order(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Counts of shingles by bucket in a sample of docs (id, text), which order them, and
    the count from which a bucket is hot."""
    shares = max(1, docs.count() // ORDER_TEXTS)
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(shares)) == 0).select("text")
    known = sample.mapInArrow(_count, "bucket long, k long").groupBy("bucket").agg(F.sum("k").alias("k")).where("k > 1").toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.uint16)
    counts[known["bucket"].to_numpy()] = np.minimum(known["k"].to_numpy(), np.iinfo(np.uint16).max)
    return counts, max(16, 8 * LIST // shares)  # far more than LIST: buckets also hold other shingles


def rare_pairs(docs: DataFrame, counts: np.ndarray, hot: int, percent: int, misses: int) -> DataFrame:
    """Candidates a, b among docs (id, n, lo, hi, text) that share rare shingles."""
    listed = docs.select("id", "n", "lo", "hi", "text").mapInArrow(partial(_list, counts=counts, hot=hot, percent=percent), _LISTED)
    dealt = listed.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(partial(_meet, percent=percent, misses=misses), "a long, b long")


_HELD = "shingle long, place int, id long, n long, lo long, hi long, component long"


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """The prefix shingles of each class with their place in its order."""
    names = [c.split()[0] for c in _HELD.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            found = []
            for k, (n, text) in enumerate(zip(part.column(1).to_pylist(), part.column(5), strict=True)):
                s = shingle_set(text.as_py())
                if len(s) == n:  # else another text of a repeated id
                    found.append((k, prefix(s, counts, percent)[0]))
            if not found:
                continue
            size = [len(p) for _, p in found]
            of = np.repeat([k for k, _ in found], size)
            place = np.concatenate([np.arange(x, dtype=np.int32) for x in size])
            cols = [_signed(np.concatenate([p for _, p in found])), place, *(part.column(c).to_numpy()[of] for c in (0, 1, 2, 3, 4))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def crossing(place, ids, n, lo, hi, component, block, percent: int, misses: int) -> np.ndarray:
    """Candidates (smaller id, larger id) of different components among classes that share
    a shingle, at the given places in their orders.  If it is the first one that a pair
    shares, what lies behind it bounds their intersection.  Where there are two blocks,
    only classes of different blocks meet."""
    lo, hi = lo.view(np.uint64), hi.view(np.uint64)
    order = np.argsort(component, kind="stable")
    _, size = np.unique(component[order], return_counts=True)
    largest = int(size.argmax())
    begin = size[:largest].sum()
    order = np.concatenate([order[:begin], order[begin + size[largest] :], order[begin : begin + size[largest]]])  # the largest one last
    rest = n[order] - place[order]
    out = []
    behind = np.cumsum(np.delete(size, largest))
    stops = np.repeat(behind, np.diff(behind, prepend=0))
    apart = bool(block.min() != block.max())
    for i, stop in enumerate(stops.tolist()):
        a, others = order[i], order[stop:]
        ok = (lo[a] ^ lo[others]) | (hi[a] ^ hi[others])
        ok = np.bitwise_count(ok) <= misses
        ok &= (100 + percent) * np.minimum(rest[i], rest[stop:]) >= percent * (n[a] + n[others])
        ok &= 100 * np.minimum(n[a], n[others]) >= percent * np.maximum(n[a], n[others])
        if apart:
            ok &= block[a] != block[others]
        met = others[ok]
        if len(met):
            out.append(np.stack([np.minimum(ids[a], ids[met]), np.maximum(ids[a], ids[met])], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _cross(batches: Iterator[pa.RecordBatch], percent: int, misses: int) -> Iterator[pa.RecordBatch]:
    """Rows of shingle, x, y, place, id, n, lo, hi, component, block, sorted by the first three."""
    held: list[pa.RecordBatch] = []

    def pairs(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(got)
        cols = [t.column(k).to_numpy() for k in range(t.num_columns)]
        new = np.ones(len(t), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        starts = np.flatnonzero(new)
        found = [crossing(*(c[a:b] for c in cols[3:]), percent, misses) for a, b in zip(starts, np.append(starts[1:], len(t)), strict=True) if b - a > 1]
        p = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        for at in range(0, len(p), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(p[at : at + 50_000, 0]), pa.array(p[at : at + 50_000, 1])], names=["a", "b"])

    for batch in batches:  # a list may go on in the next batch; its blocks are bounded
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy() for k in range(3)]
        changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
        done = int(changes[-1]) + 1 if len(changes) else 0
        if held and any(held[-1].column(k)[-1].as_py() != key[k][0] for k in range(3)):
            yield from pairs(held)
            held = []
        if done:
            yield from pairs([*held, batch.slice(0, done)])
            held = []
        held.append(batch.slice(done))
    if held:
        yield from pairs(held)


def crossing_pairs(docs: DataFrame, counts: np.ndarray, percent: int, misses: int) -> DataFrame:
    """Candidates a, b among docs (id, n, lo, hi, component, text) that share a rare shingle
    and lie in different components."""
    rows = scratch_table(docs.select("id", "n", "lo", "hi", "component", "text").mapInArrow(partial(_prefixes, counts=counts, percent=percent), _HELD), "prefix_rows")
    lists = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    lists = scratch_table(lists.where("low <> high").select("shingle", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "crossing_lists")
    met = split_join(rows, lists, ["shingle"], F.col("id")).withColumn("block", F.pmod(F.xxhash64("id", "shingle"), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("shingle", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "place", "id", "n", "lo", "hi", "component", "block")
    dealt = met.repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y")
    return dealt.mapInArrow(partial(_cross, percent=percent, misses=misses), "a long, b long")


def similar_sets(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    last, of_last = None, None
    for batch in batches:
        a, b, ta, tb = (batch.column(k) for k in range(4))
        ok = []
        for k in range(len(a)):
            x = b[k].as_py()
            if x != last:
                last, of_last = x, shingle_set(tb[k].as_py())
            ok.append(similar_sets(shingle_set(ta[k].as_py()), of_last, percent))
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def confirmed(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets of shingles, made from rows (id, text), are similar enough."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # all three sides grow with the corpus: shuffle joins at every size, never a broadcast
    texts = scratch_table(rows.join(named.hint("merge"), "id", "left_semi"), "texts")
    ta, tb = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    with_a = split_join(pairs, ta, ["a"], F.col("b"))
    both = split_join(with_a, tb, ["b"], F.col("a"), counted=pairs).select("a", "b", "ta", "tb")
    return scratch_table(both.mapInArrow(partial(_confirm, percent=percent), "a long, b long"), "confirmed")


def components(links: DataFrame) -> DataFrame:
    """Node and component (its smallest node) of an undirected graph of links a, b:
    alternating large-star and small-star steps until nothing changes.  A node with a
    large part of all links is cut up in the joins."""
    edges = scratch_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = split_join(both, least, ["u"], F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch_table(large, "large_stars")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, lowest, ["u"], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = scratch_table(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def near_links(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT, misses: int = MISSES) -> tuple[DataFrame, DataFrame]:
    """(classes, links): id, n, rep of every row, and the confirmed links between class
    representatives of a Jaccard similarity of percent or more.  rep is null for rows
    without an id or without shingles.  misses must suit percent: see MISSES; with SKETCH
    no candidate is dropped by its sketch, and each is decided by full sets."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = scratch_table(rows.mapInArrow(_sign, "id long, n long, f1 long, f2 long, lo long, hi long, sig binary"), "signatures")
    whole = F.col("id").isNotNull() & (F.col("n") > 0)
    full = signed.where(whole)
    classes = scratch_table(full.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "class_ids")
    reps = full.join(classes.select(F.col("rep").alias("id"), "f1", "f2"), ["id", "f1", "f2"], "left_semi").dropDuplicates(["id", "f1", "f2"])
    reps = scratch_table(reps.select("id", "n", "lo", "hi", "sig"), "classes")
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    forest = reps.select("id", "n", "lo", "hi", "sig", trees).select(
        "tree", F.expr(f"substring(sig, tree * {_KEY} + 1, {_KEY})").alias("key"), "id", "n", "lo", "hi"
    )
    order = ["tree", "key", "lo", "hi", "id"]
    ranges = max(1, -(-reps.count() * TREES // RANGE_ROWS))
    dealt = forest.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = scratch_table(dealt.mapInArrow(partial(_candidates, percent=percent, misses=misses), _CANDIDATE), "candidates")
    hubs = reps.select("lo", "hi", F.col("id").alias("hub")).groupBy("lo", "hi").agg(F.min("hub").alias("hub"))
    asked = found.where("lo is not null")
    answered = hubs.join(asked.select("lo", "hi").distinct(), ["lo", "hi"], "left_semi")
    # at most 2 * DEPTH sketches for each range partition
    central = asked.join(F.broadcast(answered), ["lo", "hi"]).select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b")).where("a <> b")
    pairs = found.where("b is not null").select("a", "b").unionByName(central)
    # a row without b and lo for each tree in which a class shares its first hash with many
    common = found.where("b is null and lo is null").groupBy(F.col("a").alias("id")).count()
    doubtful = scratch_table(common.where(F.col("count") > COMMON_TREES).select("id"), "doubtful")
    dense = not doubtful.isEmpty()
    if dense:
        sketches = reps.select("id", "n", "lo", "hi").join(doubtful.hint("merge"), "id")
        doubtful = scratch_table(sketches.join(rows.hint("merge"), "id"), "doubtful_texts")
        counts, hot = shingle_order(doubtful)
        pairs = pairs.unionByName(rare_pairs(doubtful, counts, hot, percent, misses))
    pairs = scratch_table(pairs.distinct(), "pairs")
    links = confirmed(pairs, rows, percent)
    if dense:
        groups = components(links).withColumnRenamed("node", "id").hint("merge")
        placed = doubtful.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
        more = crossing_pairs(placed, counts, percent, misses).distinct().join(pairs.hint("merge"), ["a", "b"], "left_anti")
        more = scratch_table(more, "crossing_pairs")
        if not more.isEmpty():
            links = links.unionByName(confirmed(more, rows, percent))
    named_rows = split_join(full.select("id", "n", "f1", "f2"), classes, ["f1", "f2", "n"], F.col("id")).select("id", "n", "rep")
    return named_rows.unionByName(signed.where(~whole).select("id", "n", F.lit(None).cast("long").alias("rep"))), links


def near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT, misses: int = MISSES) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (the smallest id reachable), kept.
    ids are integers.

    Null, empty and blank texts have no shingles and no links.  Rows without an id are
    never linked; their component is null and they are kept.  Rows that repeat an id
    are one node of the graph.  Other columns are ignored; an empty table gives an
    empty result.
    """
    classes, links = near_links(docs, text_col, id_col, percent, misses)
    groups = components(links)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    met = split_join(classes, groups.withColumnRenamed("node", "rep"), ["rep"], F.col("id"), "left")
    return met.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT, misses: int = MISSES) -> DataFrame:
    """docs with one row of each component; all columns stay.

    Rows are decided one by one: those that repeat an id or have none are documents of
    their own, and of equal rows one stays.  Rows without shingles all stay.  ids may be
    of any type."""
    rows, key = with_row_key(docs, id_col)
    dropped = near_copies(rows, text_col, key, percent, misses).where("not kept").select(key)
    return rows.join(dropped, key, "left_anti").drop(key)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) c
  JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * c.k >= 85 * (p.n + q.n - c.k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
