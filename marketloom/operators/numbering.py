"""Whole-table numbering and neighbours without a single-task window.

A window without PARTITION BY runs on one task. Here the table is range-partitioned by the ordering column,
sorted inside each range, and written once with the number of its range and the row's place in it. Everything
else is a summary with one row per range. There are as many ranges as the session has shuffle partitions,
so they grow with the cluster; a lost executor repeats a range before the write is committed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import written


def in_ranges(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """``df`` sorted into ranges of ``column`` (NULLs last), with ``_range`` and ``_place`` (from 0 in each range).
    Rows with equal values are told apart by their hash, so a repeated value spreads over ranges."""
    order = [F.asc_nulls_last(column), F.xxhash64(*[F.col(c) for c in df.columns])]
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    # The id counts the rows of a task from 0 below its 33rd bit, in the order of the sort.
    row_id = F.monotonically_increasing_id()
    placed = dealt.sortWithinPartitions(*order).select("*", row_id.alias("_row_id"))
    split = placed.selectExpr("* EXCEPT (_row_id)", "shiftright(_row_id, 33) AS _range", f"_row_id & {(1 << 33) - 1}L AS _place")
    return written(split, "ranges")


def global_row_number(df: DataFrame, order_by: str, name: str, ranges: int | None = None) -> DataFrame:
    """``row_number() over (order by order_by)``: the place in the range and the size of the ranges below it.
    Rows with equal values are numbered in any order."""
    ranged = in_ranges(df, order_by, ranges)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.join(F.broadcast(offsets), "_range")  # one row for each range
        .withColumn(name, F.col("_place") + F.col("_offset") + 1)
        .drop("_range", "_place", "_offset")
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys where NULL keys meet; the result has the left keys once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, met, how).drop(*[f"_right_{k}" for k in keys])


def with_previous(
    distinct: DataFrame, column: str, name: str, partition_by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Add the next smaller value of ``column`` in its partition.

    ``distinct`` has each (partition, value) once. Inside a range the value comes from LAG; the
    first row of a range takes the largest value of the nearest range below it, from a summary
    with one row per partition and range.
    """
    return _with_neighbour(distinct, column, name, partition_by, ranges, forward=False)


def with_next(
    distinct: DataFrame, column: str, name: str, partition_by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Add the next larger value of ``column`` in its partition (see ``with_previous``)."""
    return _with_neighbour(distinct, column, name, partition_by, ranges, forward=True)


def _with_neighbour(
    distinct: DataFrame, column: str, name: str, partition_by: Sequence[str], ranges: int | None, forward: bool
) -> DataFrame:
    group = [*partition_by, "_range"]
    ranged = in_ranges(distinct, column, ranges)
    step, edge = (F.lead, F.min) if forward else (F.lag, F.max)
    inside = Window.partitionBy(*group).orderBy(F.asc_nulls_last(column))
    across = Window.partitionBy(*partition_by).orderBy("_range")
    edges = ranged.groupBy(*group).agg(edge(column).alias("_edge"))
    carried = edges.select(*group, step("_edge").over(across).alias("_carry"))
    near = ranged.withColumn("_near", step(column).over(inside))
    return join_null_safe(near, carried, group).select(
        *distinct.columns, F.coalesce("_near", "_carry").alias(name)
    )
