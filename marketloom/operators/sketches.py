"""Sketches that are kept per period and combined later: frequent values and distinct counts.

A sketch has a bounded size, whatever it has seen, so a longer period is made of the stored sketches of its days or months
and the rows are not read again. Sums and counts of rows stay exact elsewhere; only what cannot be added up is
estimated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values a frequent-value sketch tracks, a power of two.
TRACKED = 64
#: Registers of a distinct-count sketch, as a power of two.
REGISTERS = 12
#: Standard error of an estimated distinct count, relative to it.
STANDARD_ERROR = 1.04 / 2 ** (REGISTERS / 2)


def frequent_values(df: DataFrame, keys: Sequence[str], column: str, tracked: int = TRACKED) -> DataFrame:
    """``keys``, ``sketch`` of the values of a column, and ``seen``, how many there are; NULL is not counted."""
    known = df.filter(F.col(column).isNotNull())
    return known.groupBy(*keys).agg(F.expr(f"approx_top_k_accumulate({column}, {int(tracked)})").alias("sketch"), F.count(column).alias("seen"))


def combined_values(sketches: DataFrame, keys: Sequence[str], tracked: int = TRACKED) -> DataFrame:
    """Sketches of ``frequent_values`` combined over coarser keys."""
    return sketches.groupBy(*keys).agg(F.expr(f"approx_top_k_combine(sketch, {int(tracked)})").alias("sketch"), F.sum("seen").alias("seen"))


def top_values(sketches: DataFrame, keys: Sequence[str], name: str, k: int = 8, tracked: int = TRACKED) -> DataFrame:
    """The most frequent value of each sketch by its estimated count (ties by value), ``estimated``, ``seen`` and ``error``.

    The table behind a sketch has a power of two of places, at least four thirds of ``tracked``. It pushes values out
    when three quarters of the places are taken, so up to so many rows the counts are exact (error 0); beyond that
    a count is off by at most 3.5 times ``seen`` over the places.
    """
    if not 1 <= k <= tracked // 2:
        raise ValueError(f"{k} of {tracked} tracked values")
    places = 1 << math.ceil(math.log2(tracked / 0.75))
    estimate = F.expr(f"approx_top_k_estimate(sketch, {int(k)})")
    best = F.array_min(F.transform(estimate, lambda x: F.struct((-x["count"]).alias("n"), x["item"].alias("value"))))
    found = sketches.select(*keys, best.alias("best"), "seen")
    error = F.when(F.col("seen") <= 3 * places // 4, F.lit(0)).otherwise(F.ceil(F.col("seen") * (3.5 / places))).cast("long")
    return found.select(*keys, F.col("best.value").alias(name), (-F.col("best.n")).alias("estimated"), "seen", error.alias("error"))


def distinct_counts(df: DataFrame, keys: Sequence[str], column: str, registers: int = REGISTERS) -> DataFrame:
    """``keys`` and a ``sketch`` of the distinct values of a column."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, F.lit(registers)).alias("sketch"))


def combined_counts(sketches: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Estimated distinct values over coarser keys, from the sketches of finer ones."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
