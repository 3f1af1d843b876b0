"""Last touch before an event, within a look-back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_touch(
    events: DataFrame,
    touches: DataFrame,
    key: str,
    event_day: str,
    touch_day: str,
    order_by: Sequence[str],
    lookback_days: int = 30,
) -> DataFrame:
    """Each event with the latest touch of its key on or up to ``lookback_days`` before its day.

    ``order_by`` are touch columns that decide between touches of one day (largest first), and
    are also the columns returned. Events without a touch drop out.

    Events × touches are never formed. The answer depends only on key and day, so touches are
    first reduced to the winner of each key and day (partial aggregation), events to their
    distinct key-days, and both are walked in time order per key: at most two rows per key and
    calendar day, however many events a key has. The answer is then joined back to the events.
    """
    winners = (
        touches.filter(F.col(key).isNotNull() & F.col(touch_day).isNotNull())
        .groupBy(F.col(key).alias("_key"), F.col(touch_day).alias("_day"))
        .agg(F.max(F.struct(*order_by)).alias("_touch"))
    )
    asked = events.select(F.col(key).alias("_key"), F.col(event_day).alias("_day")).distinct()
    touch = F.struct(F.col("_day").alias("day"), F.col("_touch").alias("touch"))
    walk = winners.select("_key", "_day", F.lit(0).alias("_kind"), touch.alias("_seen")).unionByName(
        asked.select("_key", "_day", F.lit(1).alias("_kind")), allowMissingColumns=True
    )
    order = Window.partitionBy("_key").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = (
        walk.withColumn("_last", F.last("_seen", ignorenulls=True).over(order))
        .filter((F.col("_kind") == 1) & (F.col("_last.day") >= F.date_sub("_day", lookback_days)))
        .select("_key", "_day", F.col("_last.day").alias(f"last_{touch_day}"), "_last.touch.*")
    )
    met = (F.col(key) == F.col("_key")) & (F.col(event_day) == F.col("_day"))
    return events.join(latest, met).drop("_key", "_day")
