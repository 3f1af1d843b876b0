"""Stream forms of the incremental runs: keyed upserts and daily totals with late data."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.functions.scalars import exprs
from marketloom.operators.shape import deduplicate
from marketloom.operators.upsert import KeyedTable
from marketloom.session import written


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def upsert_stream(
    rows: DataFrame,
    table: KeyedTable,
    newest_first: Sequence[str],
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    then: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Upsert every micro-batch by key: the newest row of a key wins, within a batch and against the
    stored row, by the columns ``newest_first`` (which the table has). Of rows that are equally new, the one
    that came last stays; a batch that is delivered again writes the same rows again. ``then`` gets the newest row of each
    key of the batch when the table holds it or a newer one. A batch without rows changes nothing and is not told."""

    def apply(batch: DataFrame, _: int) -> None:
        # A batch is planned once, whatever is done with it, and only what can win is written.
        newest = written(deduplicate(transform(batch), table.keys, [F.desc(c) for c in newest_first]), "batch")
        latest = newest
        if table.exists():
            if newest.isEmpty():
                return
            order = [F.col(c) for c in newest_first]
            stored = table.read().select(*table.keys, F.struct(*order).alias("_stored")).hint("merge")  # never a broadcast
            both = newest.withColumn("_arrived", F.struct(*order)).join(stored, table.keys, "left")
            latest = both.filter("_stored IS NULL OR _arrived >= _stored").select(*newest.columns)
        table.upsert(latest)
        if then is not None:
            then(newest)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_parents(
    changes: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], table: KeyedTable, checkpoint: str
) -> StreamingQuery:
    """Rows that follow their parents: ``changes`` is a stream of the parents' keys, from every table whose arrivals change
    the rows. For the distinct keys of each batch ``build`` plans the rows anew from the landed tables, and they are upserted.
    A row that arrives before its parent is built when the parent's key comes; a batch that is
    delivered again ends in the same table."""

    def apply(batch: DataFrame, _: int) -> None:
        table.upsert(build(written(batch.select(key).distinct(), "changed-keys")))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_totals(daily: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Append form of ``daily_totals``: a day is written once, when the watermark has passed its end, and never again.
    A batch that is delivered again writes the same days again."""

    def apply(batch: DataFrame, _: int) -> None:
        table.upsert(batch)

    return (
        daily.writeStream.outputMode("append")
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def keep_late(rows: DataFrame, time: str, table: KeyedTable, checkpoint: str, late_days: int = 3) -> StreamingQuery:
    """The rows that ``closed_totals`` does not count, because their day was closed before they came.

    A day is closed for a batch if its end is not after the newest time of all batches before, less ``late_days``. That
    newest time is the table's mark, with the number of the batch, so a batch that is delivered again meets the
    same days closed. Both queries must read the same arrivals in the same batches.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch = written(batch, "batch")
        mark = json.loads(table.mark()) if table.exists() else {"batch": None, "before": None, "newest": None}
        before = mark["before"] if mark["batch"] == number else mark["newest"]
        newest = batch.agg(F.max(F.col(time).cast("timestamp")).cast("string")).first()[0]
        end = F.date_trunc("day", time) + F.expr("interval 1 day")
        closed = F.lit(before).cast("timestamp") - F.expr(f"interval {int(late_days)} days")
        came_late = batch.filter(F.coalesce(end <= closed, F.lit(False)))
        newest = max((t for t in (before, newest) if t is not None), default=None)
        table.upsert(came_late, mark=json.dumps({"batch": number, "before": before, "newest": newest}))

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_totals(rows: DataFrame, time: str, keys: Sequence[str], totals: Sequence[str], late: str = "3 days") -> DataFrame:
    """Totals per day and keys over event time; rows later than ``late`` are not waited for."""
    return (
        rows.withWatermark(time, late)
        .groupBy(F.window(time, "1 day").alias("_day"), *keys)
        .agg(*exprs(*totals))
        .withColumn("day", F.expr("date(_day.start)"))
        .drop("_day")
    )


def maintain_daily_totals(daily: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Write changed days as they change; a late row replaces the total of its day."""

    def apply(batch: DataFrame, _: int) -> None:
        table.upsert(batch)

    return (
        daily.writeStream.outputMode("update")
        .foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
