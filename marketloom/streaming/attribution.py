"""Last touch on streams: orders and touches that arrive in any order within a watermark.

Both streams are first reduced inside each task, without state: touches to the winner of each key and day,
orders to their key-days. A key with a third of all events thus brings at most one row for each day and task to the
join. The join is a stream-stream join on key and interval; its state holds the look-back and the
watermark's delay and no more. Pairs arrive whenever their later half does, so the table of credits keeps
the best touch of every key-day, and months that saw a change are summed again as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.operators.upsert import KeyedTable
from marketloom.streaming.flows import upsert_stream


def _winners(keys: Sequence[str], order_by: Sequence[str]):
    """Of the rows of a task's batch with equal keys, the one with the largest values (NULL the least)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if order_by:
                frame = frame.sort_values(list(order_by), na_position="first", kind="stable")
            yield frame.drop_duplicates(list(keys), keep="last")

    return run


def touch_pairs(
    orders: DataFrame,
    touches: DataFrame,
    key: str,
    order_day: str,
    touch_day: str,
    order_by: Sequence[str],
    lookback_days: int = 30,
    late: str = "3 days",
) -> DataFrame:
    """Stream of (``key``, ``order_day``, ``last_<touch_day>``, columns ``order_by``): key-days of orders with touches on
    or up to ``lookback_days`` before them. Rows that are later than ``late`` against the newest row of their stream take no
    part; NULL keys and days neither."""
    known = f"{key} IS NOT NULL AND {{}} IS NOT NULL"
    asked = orders.filter(known.format(order_day)).select(key, F.col(order_day).cast("timestamp").alias("_at"))
    asked = asked.mapInPandas(_winners([key, "_at"], []), asked.schema).withWatermark("_at", late)
    seen = touches.filter(known.format(touch_day)).select(F.col(key).alias("_key"), F.col(touch_day).cast("timestamp").alias("_touched"), *order_by)
    seen = seen.mapInPandas(_winners(["_key", "_touched"], order_by), seen.schema).withWatermark("_touched", late)
    near = F.expr(f"_touched <= _at AND _touched >= _at - interval {int(lookback_days)} days")
    return asked.join(seen, (F.col(key) == F.col("_key")) & near).select(
        key, F.to_date("_at").alias(order_day), F.to_date("_touched").alias(f"last_{touch_day}"), *order_by
    )


def maintain_last_touch(
    pairs: DataFrame, credits: KeyedTable, touch_day: str, order_by: Sequence[str], checkpoint: str, changed: Callable[[DataFrame], None] | None = None
) -> StreamingQuery:
    """Keep the best touch of every key-day in ``credits`` (keyed by key and day). ``changed`` gets the key-days of every
    batch after they are stored; a batch that is delivered again ends in the same tables.

    The join keeps its state in as many partitions as the cluster has cores when the checkpoint is new: each partition costs
    four stores to open and commit in every batch, however little they hold, so partitions by bytes would take most of the time."""
    newest = [f"last_{touch_day}", *order_by]
    spark = pairs.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    # A query takes a copy of the settings when it starts, and those of its checkpoint when it goes on.
    spark.conf.set("spark.sql.shuffle.partitions", min(int(before), spark.sparkContext.defaultParallelism))
    try:
        return upsert_stream(pairs, credits, newest, checkpoint, then=changed)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def credited(orders: DataFrame, credits: DataFrame, key: str, order_day: str) -> DataFrame:
    """Every order with the stored touch of its key-day; orders without one drop out."""
    stored = credits.withColumnsRenamed({key: "_key", order_day: "_day"})
    met = (F.col(key) == F.col("_key")) & (F.col(order_day) == F.col("_day"))
    return orders.join(stored, met).drop("_key", "_day")
