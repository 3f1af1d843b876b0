"""Bounded samples and tops that no single task has to gather from all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_hash(df: DataFrame, column: str, sample: int) -> DataFrame:
    """At most ``sample`` rows, those with the smallest hashes of ``column`` (as text).

    A bound on the hashes, from the number of rows, leaves a little over ``sample`` rows before they
    are sorted. Rows that share a value share its hash; of those at the bound some may go.
    """
    rows = df.withColumn("_hash", F.xxhash64(F.col(column).cast("string")))
    share = (sample + 5 * sample**0.5 + 10) / max(1, df.count())
    if share < 1:
        rows = rows.where(F.col("_hash") < int(-(2**63) + share * 2**64))
    return rows.orderBy("_hash", F.col(column).cast("string")).limit(sample).drop("_hash")


def most_frequent(df: DataFrame, count_column: str, most: int) -> DataFrame:
    """Rows with the largest counts, as many whole classes of counts as fit in ``most`` rows.

    The classes, eight for each power of two, are counted first; the rows themselves are then a filter.
    """
    klass = F.floor(8 * F.log2(F.col(count_column).cast("double"))).cast("int")
    rows = df.withColumn("_class", klass)
    total, least = 0, 1 << 30
    for number, times in sorted(rows.groupBy("_class").count().collect(), reverse=True):  # at most 512 rows
        total += times
        if total > most:
            break
        least = number
    return rows.where(F.col("_class") >= least).drop("_class")
