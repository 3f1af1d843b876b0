"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Vectors become whole numbers. Rows are cut into blocks, and every block keeps, for each dimension, its
rows sorted by their value there. Queries are cut into blocks too, and a block of queries walks
the lists of a block of rows: from the top where the query's component is positive, from the bottom
where it is negative. After each step of the walk, the inner product of the query with the values at
the current depth bounds the score of every row not seen yet. The walk ends when this bound is
below the k-th best score so far: a row that only ties with it could still win by its smaller id, so
ties are walked. Rows seen are scored in full. Each pair of blocks gives at most k rows per query,
and a window per query keeps the best of all blocks.

The stated queries meet all rows, block by block. A first pass walks each query block down one
block of rows only, so that later walks start with a k-th score that already ends most of them early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import written

SCALE = 256
#: Rows and queries of a block.
ROWS, QUERIES = 4_096, 64
#: Rows taken from each list in the first step of a walk; each further step is twice as deep.
FIRST_STEP = 8
LOWEST = -(1 << 62)
NO_FLOORS = "CAST(array() AS array<bigint>) AS floors"


def whole_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): components ``floor(256 x)`` of the rows that take part."""
    raw = F.col(vector_column).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(id_column).cast("long").alias("id"), raw.alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: F.coalesce(finite(x), F.lit(False))))
    return rows.select("id", F.transform("x", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def _blocks(rows: DataFrame, size: int, salt: str, counts: dict[int, int]) -> DataFrame:
    """Rows dealt into blocks of about ``size`` rows with vectors of one length, each one row: d, block, ids, values."""
    many = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, -(-n // size))])
    dealt = rows.select("id", "v", F.size("v").alias("d"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), many[F.col("d")]).cast("int"))
    packed = dealt.groupBy("d", "block").agg(F.collect_list(F.struct("id", "v")).alias("items"))
    return packed.select("d", "block", F.col("items.id").alias("ids"), F.flatten("items.v").alias("values"))


class _Lists:
    """The rows of a block, and for each dimension the rows in ascending order of value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")  # equal scores then come by id
        self.ids, self.values = ids[order], values[order]
        # Sums of products of small whole numbers are exact as floating-point numbers, and faster.
        self.small = np.abs(self.values).max(initial=0) < 1 << 20 and self.values.shape[1] <= 4096
        self.floating = self.values.astype(float) if self.small else self.values
        self.ascending = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.ascending, axis=0)

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.small and np.abs(query).max(initial=0) < 1 << 20:
            return (self.floating[rows] @ query.astype(float)).astype(np.int64)
        return self.values[rows] @ query

    def bound(self, query: np.ndarray, depth: int) -> int:
        """The most that a row below ``depth`` in all lists can score."""
        if depth >= len(self.ids):
            return LOWEST
        deep = np.where(query > 0, self.sorted[len(self.ids) - 1 - depth], self.sorted[depth])
        return int(deep @ query)

    def seen(self, query: np.ndarray, start: int, end: int) -> np.ndarray:
        """The rows at depths ``start:end`` of the lists."""
        n = len(self.ids)
        top = self.ascending[max(0, n - end) : max(0, n - start), query > 0]
        bottom = self.ascending[start:end, query < 0]
        flat = self.ascending[start:end, :1] if not query.any() else np.zeros(0, np.int64)
        return np.concatenate([top.ravel(), bottom.ravel(), np.ravel(flat)])

    def best(self, query: np.ndarray, own: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of up to k rows that score at least ``floor``, by the threshold algorithm."""
        n, depth, step = len(self.ids), 0, FIRST_STEP
        known = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while depth < n and self.bound(query, depth) >= floor:
            fresh = np.zeros(n, bool)
            fresh[self.seen(query, depth, min(n, depth + step))] = True
            fresh &= ~known
            known |= fresh
            at = np.flatnonzero(fresh)
            at = at[self.ids[at] != own]
            rows, scores = np.concatenate([rows, at]), np.concatenate([scores, self.scores(query, at)])
            keep = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[keep], scores[keep]
            if len(rows) == k:
                floor = max(floor, int(scores[-1]))
            depth, step = depth + step, step * 2
        keep = scores >= floor
        return self.ids[rows[keep]], scores[keep]


def _search(k: int):
    """The best rows of each block of rows for each block of queries that follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = None
        for batch in batches:
            for at in range(batch.num_rows):
                d, asked = batch.column("d")[at].as_py(), batch.column("asked")[at].as_py()
                ids, values, floors = (batch.column(c)[at].values.to_numpy() for c in ("ids", "values", "floors"))
                values = values.reshape(len(ids), d)
                if asked < 0:
                    lists = _Lists(ids, values)
                    continue
                found = [lists.best(q, own, k, int(f)) for own, q, f in zip(ids, values, floors, strict=True)]
                owners = np.repeat(ids, [len(f[0]) for f in found])
                columns = [owners, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(``query_id``, ``rank`` from 1, ``vec_id``, ``score``) of the k best rows for each row that the
    condition ``queries`` (over the id column) holds for; fewer where there are fewer.

    Scores are inner products of whole numbers; ties go to the smaller id. A row's own id is no
    candidate. Vectors that are NULL or hold a NULL or non-finite component take no part, nor do rows
    with NULL id; vectors of different lengths don't meet. Of rows that repeat an id the one with the
    largest vector takes part. Other columns are ignored; an empty table gives an empty result. Scores must
    fit a long.
    """
    spark = df.sparkSession
    rows = whole_vectors(df, id_column, vector_column).groupBy("id").agg(F.max("v").alias("v")).where(F.size("v") > 0)
    rows = written(rows.select("id", "v", F.size("v").alias("d")), "vectors")
    asked = rows.withColumn(id_column, F.col("id")).where(queries).select("id", "v", "d")
    counts, sought = (dict(x.groupBy("d").count().collect()) for x in (rows, asked))  # a row for each length of vector
    if not sought:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    number = {d: -(-n // ROWS) for d, n in counts.items()}
    data = written(_blocks(rows, ROWS, "rows", counts), "row-blocks").select("d", "block", F.lit(-1).alias("asked"), "ids", "values", F.expr(NO_FLOORS))
    ask = written(_blocks(asked, QUERIES, "queries", sought), "query-blocks").withColumnRenamed("block", "asked")
    last = F.create_map(*[F.lit(x) for d, n in number.items() for x in (d, n - 1)])[F.col("d")]

    def walk(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
        """Every block of rows, followed by the query blocks dealt to it."""
        both = blocks.unionByName(pairs.select(blocks.columns))
        dealt = both.repartition(max(8, sum(number.values()) // 4), "d", "block").sortWithinPartitions("d", "block", "asked")
        return dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long")

    unbounded = F.transform("ids", lambda _: F.lit(LOWEST)).alias("floors")
    first = walk(ask.select("*", F.lit(0).alias("block"), unbounded), data.where("block = 0"))
    first = written(_ranked(first, k), "first-walk")
    # The k-th score of the first block, where it has k rows, bounds every further walk from below.
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    known = ask.select("d", "asked", F.posexplode("ids").alias("at", "query_id")).join(bounds, "query_id", "left")
    known = known.groupBy("d", "asked").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("floor", F.lit(LOWEST)).alias("f")))).alias("floors"))
    known = known.withColumn("floors", F.col("floors.f"))
    dealt = ask.join(known, ["d", "asked"]).where(last > 0).withColumn("block", F.explode(F.sequence(F.lit(1), last)))
    found = first.select("query_id", "vec_id", "score").unionByName(walk(dealt, data.where("block > 0")))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
