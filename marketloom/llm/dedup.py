"""Exact duplicates by a content sort, with DataFrame functions only.

Normalised texts are range-partitioned by sampled splitters over (leading characters, SHA-256,
share) and sorted outside memory inside each partition, which puts equal texts next to each
other. Each row is then compared in full with its neighbour, so the digest only guides the sort:
two texts with one digest would still be told apart. The splitters are sampled over these bounded
keys, so the driver never sees a whole text.

A text that more than a thousandth of the rows carry is cut into shares by its row ids, each
sorted by itself; the first rows of the shares (some thousands at most, whatever the size of the
table) are compared in full once more and merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import written

HEAD = 24
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    """NULL as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal normalised texts the row with the smallest id is kept; NULL ids come last, and of rows
    that repeat an id one is kept. A NULL text equals the empty text. Other columns of ``df`` are
    ignored, whatever their names. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_column).alias("_id"), normalised(F.col(text_column)).alias("_text")).select(
        "_id", "_text", F.substring("_text", 1, HEAD).alias("_head"), F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")
    )
    per_share = max(1, df.count() // HOT_SHARE)
    hot = rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > per_share)
    shares = F.ceil(F.col("_copies") / per_share).cast("int")
    dealt = (
        rows.join(F.broadcast(hot), "_sha", "left")  # count > rows / 1000: under 2,000 texts at any size
        .withColumn("_shares", F.coalesce(shares, F.lit(1)))
        .withColumn("_share", F.pmod(F.xxhash64("_id"), F.col("_shares")).cast("int"))
        .drop("_copies")
    )
    key = ["_head", "_sha", "_share"]
    order = Window.partitionBy(*key).orderBy("_text", F.asc_nulls_last("_id"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        dealt.repartitionByRange(*key)
        .withColumn("_first", ~F.col("_text").eqNullSafe(F.lag("_text").over(order)))
        .withColumn("_run", F.sum(F.col("_first").cast("int")).over(so_far))
        .withColumn("_least", F.last(F.when(F.col("_first"), F.struct("_id")), ignorenulls=True).over(so_far))
        .withColumn("_text", F.when(F.col("_first") & (F.col("_shares") > 1), F.col("_text")))
        .withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*key, "_run")))
    )
    runs = written(runs.drop("_head"), "content-runs")
    # One row per share of a hot text. Equal texts meet by full comparison.
    of_share = Window.partitionBy("_sha", "_text")
    merged = runs.where("_first and _shares > 1").select(
        "_sha",
        "_share",
        "_run",
        F.sum("_size").over(of_share).alias("_all"),
        F.first("_least").over(of_share.orderBy(F.asc_nulls_last("_least._id"), "_share")).alias("_leader"),
        (F.row_number().over(of_share.orderBy(F.asc_nulls_last("_least._id"), "_share")) == 1).alias("_leads"),
    )
    return (
        runs.drop("_text")
        .join(F.broadcast(merged), ["_sha", "_share", "_run"], "left")  # under 4,000 shares at any size
        .select(
            F.col("_id").alias(id_column),
            F.coalesce("_leader", "_least")["_id"].alias("keep_id"),
            F.coalesce("_all", "_size").alias("group_size"),
            (F.col("_first") & F.coalesce("_leads", F.lit(True))).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def without_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that ``exact_duplicates`` keeps, columns as they are.

    Needs ids that are unique and not NULL where rows are to be told apart: rows that repeat an id
    and a text stay together or go together.
    """
    kept = exact_duplicates(df, id_column, text_column).where("kept").select(F.col(id_column).alias("_kept_id")).distinct()
    return df.join(kept, F.col(id_column).eqNullSafe(F.col("_kept_id")), "left_semi")
