"""Set-similarity join over word shingles: a size-aware heavy-light join.

Two texts link when ``|A & B| >= t |A | B|`` over their distinct shingles, or, with D the number of
shingles in just one of them, when ``(1 + t) D <= (1 - t) (|A| + |B|)``. A text of n shingles has at most
``d``, the whole part of ``(1 - t) n``, outside the intersection. So in any fixed order of the shingles, the first
k common ones lie among the first ``d + k`` of both texts.

* Light texts (fewer shingles than the boundary) list every subset of two of their first ``d + 2``
  shingles; two light texts that link share a subset.
* Heavy texts are found through inverted lists: a text is in the list of each of its first ``d + 1``
  shingles, and heavy texts are compared with all texts of these lists.
* The boundary is the size with the least estimated cost: subsets listed, against list entries
  written and read.

The order puts shingles that many texts have last, so that common passages are in few lists. The
counts behind it are taken over all texts; they steer the work and never the result. A list that is
long nevertheless (a large group of near copies) is cut into blocks, and every two blocks meet.
Texts with equal sets are one node. Texts of fewer than ``t / (1 - t)`` shingles (9 at 0.9, 4 at 0.8) link with
nothing but equal sets: one shingle more is too many for them.

Inside a list, sizes and parity sketches (a bit per hash class, flipped by each shingle, so that
differing bits never outnumber D) rule out most pairs. Pairs that are left are compared in full, in
rounds, each of them with the components known so far and only for pairs that would tie two of them
together: the nearest of each component in each list or block, the nearest in each pair of blocks, and
all the rest. After the last round every pair that could link is compared or inside one component, where
it changes nothing; the first rounds only keep the last one small.

Shingles are 64-bit numbers; a set is known by its size and a 64-bit number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import words as W
from marketloom.llm.graph import components
from marketloom.llm.sample import most_frequent
from marketloom.session import written

#: Words of a shingle and least similarity in per cent, where a caller gives none.
WIDTH, PERCENT = 3, 90
#: Shingles whose count is kept for the order (4 MB at most, whatever the size of the table).
COUNTED = 1 << 18
#: Texts in a block of a list.
BLOCK = 256
#: Shingles looked through at once for common ones; those found this often are reported.
SPAN, OFTEN = 1 << 21, 4
#: Rounds of comparisons: pairs for each component and list (None: all), and whether two blocks are left for later.
ROUNDS = ((1, True), (1, False), (None, False))
#: Classes of ids that preselect the texts of candidate pairs (their list is 8 MB at most).
CLASSES = 1 << 20

_PROFILE = "id long, n int, s long, sketch binary, shingle long, times long"


def _outside(n: int, percent: int) -> int:
    """The most shingles of a text of ``n`` that are not in a text it links with."""
    return (100 - percent) * n // 100


def _lightest(percent: int) -> int:
    """The least size of a text that links with another set."""
    return -(-percent // (100 - percent))


def _bits(n: int, percent: int) -> int:
    more = math.ceil(math.log2(max(1, (100 - percent) / 10)))  # the lower the threshold, the more bits may differ
    return 1 << min(15, max(6, math.ceil(math.log2(max(n, 2))) - 1 + more))


def _sketch(shingles: np.ndarray, percent: int = PERCENT) -> bytes:
    bits = _bits(len(shingles), percent)
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _number(shingles: np.ndarray) -> int:
    return int(W.mix(shingles).sum(dtype=np.uint64).astype(np.int64)) if len(shingles) else 0


def _each(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its shingles) of every row of a batch with columns id and text."""
    for start, end, data, bounds in W.blocks(batch.column(1)):
        found = W.words(data, bounds)
        for i in range(end - start):
            yield start + i, W.shingles(found, i, width)


def _profiles(width: int, percent: int):
    """A row for each text (n, s, sketch), and rows (shingle, times) of common shingles."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("s", pa.int64()), ("sketch", pa.binary()), ("shingle", pa.int64()), ("times", pa.int64())])

    def common(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(sets), return_counts=True)
        values, times = values[times >= OFTEN], times[times >= OFTEN]
        empty = [pa.nulls(len(values), schema.field(k).type) for k in range(4)]
        return pa.record_batch([*empty, pa.array(values.astype(np.int64)), pa.array(times)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, total = [], 0
        for batch in batches:
            ids = batch.column(0)
            n, s, sketches = [], [], []
            for _, shingles in _each(batch, width):
                n.append(len(shingles))
                s.append(_number(shingles))
                sketches.append(_sketch(shingles, percent))
                sets.append(shingles)
                total += len(shingles)
                if total >= SPAN:
                    yield common(sets)
                    sets, total = [], 0
            none = [pa.nulls(len(n), pa.int64())] * 2
            yield pa.record_batch([ids.cast(pa.int64()), pa.array(n, pa.int32()), pa.array(s, pa.int64()), pa.array(sketches, pa.binary()), *none], schema=schema)
        if sets:
            yield common(sets)

    return run


def _boundary(sizes: list[tuple[int, int]], percent: int = PERCENT) -> int:
    """The size from which texts are heavy; ``sizes`` holds (most shingles outside, texts).

    A subset costs an entry. An entry of an inverted list also costs the others that it meets: lists of
    shingles that are not among the common ones, which come last in the order, have fewer than
    ``OFTEN`` entries for each span of shingles looked through.
    """

    def least(d: int) -> int:
        """The least size of a text with ``d`` outside."""
        return -(-100 * d // (100 - percent))

    def cost(x: int) -> float:
        light = sum(texts * math.comb(d + 2, 2) for d, texts in sizes if d < x)
        heavy = sum(texts * (d + 1) * OFTEN for d, texts in sizes if 100 * (least(d + 1) - 1) >= percent * least(x))
        return light + heavy

    top = max((d for d, _ in sizes), default=0)
    return least(min(range(1, min(top, 60) + 2), key=cost))


def _keys(common: np.ndarray, times: np.ndarray, boundary: int, width: int, percent: int):
    """List entries (key, s, n, side) of each text; bit 0 of the key marks inverted lists. The side tells
    the two blocks of a pair apart; it is 0 in lists that are whole and for a block with itself."""
    small = np.zeros(1 << 20, bool)
    small[(common & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def first(shingles: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles in the order (rare ones by number, then the others by count), counts."""
        maybe = np.flatnonzero(small[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(common, shingles[maybe]), max(0, len(common) - 1))
        is_common = common[place] == shingles[maybe] if len(common) else np.zeros(0, bool)
        maybe, place = maybe[is_common], place[is_common]
        rare = np.delete(shingles, maybe)[:length]
        counts = np.zeros(len(rare), np.int64)
        if len(rare) < length:
            last = np.lexsort((common[place], times[place]))[: length - len(rare)]
            rare, counts = np.concatenate([rare, common[place[last]]]), np.concatenate([counts, times[place[last]]])
        return rare, counts

    def blocks(key: np.ndarray, counts: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pairs of blocks that a text meets in each list, and its side there."""
        many = -(-counts // BLOCK)
        out, sides = [key[many <= 1]], [np.zeros((many <= 1).sum(), np.int8)]
        for k, m in zip(key[many > 1], many[many > 1], strict=True):
            other, own = np.arange(m, dtype=np.uint64), np.uint64(s % int(m))
            pair = np.minimum(other, own) * np.uint64(m) + np.maximum(other, own)
            out.append(W.mix(k + W.mix(pair + np.uint64(1))))
            sides.append(np.sign(other.astype(np.int64) - int(own)).astype(np.int8))
        return np.concatenate(out), np.concatenate(sides)

    one = np.uint64(1)
    schema = pa.schema([("g", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("side", pa.int8())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, sides, s_of, n_of = [], [], [], []
            for _, shingles in _each(batch, width):
                n, s = len(shingles), _number(shingles)
                if n < _lightest(percent) or s in seen:  # equal sets of one task need one entry
                    continue
                seen.add(s)
                d, own = _outside(n, percent), []
                if n < boundary:
                    head, counts = first(shingles, d + 2)
                    a, b = np.triu_indices(len(head), 1)
                    low, high = np.minimum(head[a], head[b]), np.maximum(head[a], head[b])
                    key, side = blocks(W.mix(low + W.mix(high)), np.minimum(counts[a], counts[b]), s)
                    own.append((key & ~one, side))
                if 100 * n >= percent * boundary:
                    head, counts = first(shingles, d + 1)
                    key, side = blocks(W.mix(head), counts, s)
                    own.append((key | one, side))
                for key, side in own:
                    keys.append(key)
                    sides.append(side)
                    s_of.append(np.full(len(key), s))
                    n_of.append(np.full(len(key), n, np.int32))
            if len(seen) > 1_000_000:
                seen.clear()
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(s_of)), pa.array(np.concatenate(n_of)), pa.array(np.concatenate(sides))], schema=schema)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of whole lists (equal g in the first column) of a stream sorted by g."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        total += batch.num_rows
        if total < rows:
            continue
        table = pa.Table.from_batches(held)
        g = table.column(0).to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            total = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _near_sizes(percent: int):
    """Entries, sorted by (g, n, s), whose list has another set of a size that can link."""
    names = ["g", "s", "n", "side"]

    def kept(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_met = None, False  # an entry waits for the next one
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if last is not None:
                rows = [np.append(x, y) for x, y in zip(last, rows, strict=True)]
            g, s, n, _ = rows
            if not len(g):
                continue
            new = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1]))
            rows = [x[new] for x in rows]
            g, n = rows[0], rows[2].astype(np.int64)
            meets = (g[1:] == g[:-1]) & (percent * n[1:] <= 100 * n[:-1])
            met = np.append(False, meets) | np.append(meets, False)
            met[0] |= last_met
            last, last_met = [x[-1:] for x in rows], bool(met[-1])
            yield kept([x[:-1][met[:-1]] for x in rows])
        if last is not None and last_met:
            yield kept(last)

    return run


class _Sketches:
    """Sketches of many texts by their length, to count the bits in which two differ."""

    def __init__(self, column: pa.ChunkedArray):
        sketches = column.to_pylist()
        self.size = np.array([len(x) // 8 for x in sketches])
        self.place = np.zeros(len(sketches), np.int64)
        self.rows = {}
        for size in np.unique(self.size):
            at = np.flatnonzero(self.size == size)
            self.place[at] = np.arange(len(at))
            self.rows[size] = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), size)

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for x, y in np.unique(np.stack([self.size[a], self.size[b]]), axis=1).T if len(a) else ():
            at = np.flatnonzero((self.size[a] == x) & (self.size[b] == y))
            low = min(x, y)
            for part in np.array_split(at, max(1, len(at) * int(max(x, y)) >> 20)):
                p, q = (self.rows[z][self.place[i[part]]].reshape(len(part), -1, low) for z, i in ((x, a), (y, b)))
                both = np.bitwise_xor.reduce(p, axis=1) ^ np.bitwise_xor.reduce(q, axis=1)
                out[part] = np.bitwise_count(both).sum(axis=1)
        return out


def _pairs_of(g: np.ndarray, n: np.ndarray, percent: int, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one list, sorted by (g, n), with sizes that can link."""
    run = np.cumsum(np.append(0, g[1:] != g[:-1]))
    wide = np.int64(1 << 40)
    high = np.searchsorted(run * wide + n, run * wide + 100 * n // percent, "right")
    counts = high - np.arange(len(g)) - 1
    ends = np.cumsum(counts)
    start = 0
    while start < len(g):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + at_once, "right")))
        c = counts[start:stop]
        a = np.repeat(np.arange(start, stop), c)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        yield a, b
        start = stop


def _nearest(lists: np.ndarray, comp: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray, count: int) -> np.ndarray:
    """Which pairs are among the ``count`` least apart of one of their two components in their list."""
    pair = np.tile(np.arange(len(a)), 2)
    who, where = np.concatenate([comp[a], comp[b]]), lists[a][pair]
    order = np.lexsort((pair, apart[pair], who, where))
    new = np.append(True, (who[order][1:] != who[order][:-1]) | (where[order][1:] != where[order][:-1]))
    begins = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
    keep = np.zeros(len(a), bool)
    keep[pair[order[rank < count]]] = True
    return keep


def _candidates(boundary: int, nearest: int | None, within: bool, percent: int):
    """Pairs of ids of two components (column comp) that sizes and sketches leave: all of them, or with ``nearest``
    only so many for each component and list; with ``within``, not those of two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            g, n, comp, side = (table.column(c).to_numpy().astype(np.int64) for c in ("g", "n", "comp", "side"))
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
            keep = np.repeat(mixed, np.diff(starts, append=len(g)))
            if within:
                keep &= side == 0
            table = table.filter(pa.array(keep))
            if not table.num_rows:
                continue
            g, ids, n, comp, side = (table.column(c).to_numpy().astype(np.int64) for c in ("g", "id", "n", "comp", "side"))
            sketches = _Sketches(table.column("sketch"))
            found = []
            for a, b in _pairs_of(g, n, percent):
                differ = (side[a] != side[b]) | (side[a] == 0)
                differ &= ((g[a] & 1) == 0) | (n[b] >= boundary)  # two light texts meet in subsets
                differ &= comp[a] != comp[b]
                a, b = a[differ], b[differ]
                apart = sketches.differing(a, b)
                left = (100 + percent) * apart <= (100 - percent) * (n[a] + n[b])
                a, b, apart = a[left], b[left], apart[left]
                if nearest is not None and len(a):
                    keep = _nearest(g, comp, a, b, apart, nearest)
                    a, b = a[keep], b[keep]
                found.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]))
            pair = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.record_batch([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles.tobytes() for _, shingles in _each(batch, width)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(sets, pa.large_binary())], names=["id", "shingles"])

    return run


def _compared(percent: int):
    """The pairs that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            links = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                links.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.record_batch([a, b], names=["a", "b"]).filter(pa.array(links, pa.bool_()))

    return run


def _links(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link. The texts are read again; a fixed number of id classes
    preselects them, and the join is exact."""
    klass = F.pmod(F.xxhash64("id"), F.lit(CLASSES)).alias("klass")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    wanted = ids.select(klass).distinct()  # at most CLASSES rows
    near = texts.select("id", "text", klass).join(F.broadcast(wanted), "klass", "left_semi").select("id", "text")
    sets = written(near.mapInArrow(_sets(width), "id long, shingles binary"), "sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_compared(percent), "a long, b long")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, ``n_shingles``, ``component_id``) of every row of ``df``.

    Shingles have ``width`` words; texts link at a similarity of ``percent`` (51 to 99) per cent.
    ``component_id`` is the smallest id reachable by links, the row's own included. A NULL text or
    one without words has no shingles and links with nothing. A row with NULL id is returned with its
    size and a NULL component, and links with nothing. Rows that repeat an id must repeat the
    text. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    if width < 1 or not 50 < percent < 100:  # at 50 two texts can link by one shingle, which no subset of two finds
        raise ValueError(f"width {width}, percent {percent}")
    spark = df.sparkSession
    texts = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    profiles = written(texts.mapInArrow(_profiles(width, percent), _PROFILE), "profiles")
    rows = profiles.where("n is not null").select("id", "n", "s", "sketch")
    nodes = written(
        rows.where("n > 0 and id is not null").groupBy("s", "n").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")), "nodes"
    )

    common = profiles.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    common = most_frequent(written(common, "common"), "times", COUNTED).toArrow()
    values, times = common.column("shingle").to_numpy().astype(np.uint64), common.column("times").to_numpy().astype(np.int64)
    order = np.argsort(values)
    sizes = [tuple(r) for r in rows.groupBy(F.expr(f"{100 - percent} * cast(n as bigint) div 100").alias("d")).count().collect()]
    boundary = _boundary(sizes, percent)

    keys = spark.sparkContext.broadcast((values[order], times[order], boundary, width, percent))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _keys(*keys.value)(batches)

    lists = (
        texts.where("id is not null")
        .mapInArrow(entries, "g long, s long, n int, side byte")
        .repartition("g")
        .sortWithinPartitions("g", "n", "s")
        .mapInArrow(_near_sizes(percent), "g long, s long, n int, side byte")
        .join(nodes, ["s", "n"])
        .select("g", "id", "n", "side", "sketch")
    )
    lists = written(lists, "lists")

    links, reached, tried = None, None, None
    for nearest, within in ROUNDS:
        known = lists.withColumn("comp", F.col("id"))
        if reached is not None:
            known = lists.join(reached.withColumnsRenamed({"node": "id", "component": "comp"}), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        known = known.select("g", "id", "n", "side", "comp", "sketch").repartition("g").sortWithinPartitions("g", "n", "id")
        pairs = written(known.mapInArrow(_candidates(boundary, nearest, within, percent), "a long, b long").distinct(), "pairs")
        fresh = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        found = written(_links(texts, fresh, width, percent), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        reached = components(links, "a", "b")

    named = nodes.select("s", "n", F.col("id").alias("node")).join(reached, "node", "left")
    named = named.select("s", "n", F.coalesce("component", "node").alias("component"))
    alone = rows.where("n = 0 or id is null").select("id", "n", F.when(F.col("n") >= 0, F.col("id")).alias("component"))
    grouped = rows.where("n > 0 and id is not null").join(named, ["s", "n"]).select("id", "n", "component")
    return grouped.unionByName(alone).select(
        F.col("id").alias(id_column), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id")
    )


def one_of_each(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` whose id is their component's own, columns as they are; rows with NULL id stay."""
    kept = near_duplicates(df, id_column, text_column, width, percent).where(F.col(id_column) == F.col("component_id"))
    kept = kept.select(F.col(id_column).alias("_kept_id")).distinct()
    stays = df.where(F.col(id_column).isNotNull()).join(kept, F.col(id_column) == F.col("_kept_id"), "left_semi")
    return stays.unionByName(df.where(F.col(id_column).isNull()))
