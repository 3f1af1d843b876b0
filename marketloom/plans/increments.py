"""Incremental runs: which rows a run recomputes, given what the table already holds.

Every function returns the rows to upsert. Orders are followed by the load times of all their parts: an
order whose line or return arrives later is built again, and so is its store day, campaign day or month. Any
split of the source by load time into runs, and any rerun, ends in the table a full build gives.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import month_start, zero_if_null
from marketloom.operators.upsert import since_last
from marketloom.plans.base import Inputs, day, replaced, use
from marketloom.plans.core import fct_order_items, fct_orders, inventory_daily, inventory_days, inventory_movements, store_days, store_performance
from marketloom.plans.enrich import order_items_by_order
from marketloom.plans.finance import revenue_daily
from marketloom.plans.marketing import LOOKBACK_DAYS as TOUCH_DAYS
from marketloom.plans.marketing import campaign_performance, channel_attribution
from marketloom.session import written

LOOKBACK_DAYS = 3
ORDER_TABLES = ("raw_orders", "raw_order_items", "raw_returns")


def high_water(target: DataFrame, column: str) -> dt.date | dt.datetime | None:
    """Largest value the table holds (one value; it bounds the partitions a run reads)."""
    return target.agg(F.max(column)).first()[0]


def _from(mark: dt.date | None, days: int, otherwise: dt.date) -> dt.date:
    return otherwise if mark is None else mark - dt.timedelta(days=days)


def _with_orders(inputs: Inputs, recent: DataFrame) -> Inputs:
    """The inputs cut down to the given raw orders, before any join or aggregate: a run reads
    the lines and returns of those orders only."""
    keys = recent.selectExpr("order_id AS _recent").distinct()

    def of_recent(name: str) -> DataFrame:
        return inputs[name].join(keys, F.col("order_id") == F.col("_recent"), "left_semi")

    return {
        "raw_orders": recent,
        "raw_order_items": of_recent("raw_order_items"),
        "raw_returns": of_recent("raw_returns"),
        "catalog_stores": inputs["catalog_stores"],
        "catalog_products": inputs["catalog_products"],
    }


def of_orders(inputs: Inputs, keys: DataFrame) -> Inputs:
    """The inputs cut down to the orders whose ``order_id`` is among the keys."""
    return _with_orders(inputs, _orders_among(inputs["raw_orders"], keys.select("order_id").distinct()))


def affected_orders(inputs: Inputs, cutoff: Column) -> DataFrame:
    """Ids of orders that were loaded, or had a line or return loaded, at or after the cutoff (all if it is NULL)."""
    loaded = [inputs[name].filter(cutoff.isNull() | (F.col("_loaded_at") >= cutoff)) for name in ORDER_TABLES]
    return reduce(DataFrame.unionByName, [df.select("order_id") for df in loaded]).distinct()


def _only(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose values of the columns of ``keys`` are among them; NULLs meet."""
    renamed = keys.withColumnsRenamed({c: f"_only_{c}" for c in keys.columns})
    met = [F.col(c).eqNullSafe(F.col(f"_only_{c}")) for c in keys.columns]
    return df.join(renamed, reduce(Column.__and__, met), "left_semi")


def _orders_among(orders: DataFrame, keys: DataFrame) -> DataFrame:
    """Orders whose ``order_id`` is among the distinct keys; NULLs meet. The ids are compared as they are, so orders that
    lie by them need not move."""
    unknown = keys.filter("order_id IS NULL").agg(F.count(F.lit(1)) > 0).scalar()
    met = orders.join(keys.selectExpr("order_id AS _among"), F.col("order_id") == F.col("_among"), "left")
    return met.filter(F.col("_among").isNotNull() | (F.col("order_id").isNull() & unknown)).drop("_among")


def _since(loaded_since: dt.date, lookback_days: int) -> Column:
    return F.lit(loaded_since - dt.timedelta(days=lookback_days)).cast("timestamp")


def orders_increment(
    inputs: Inputs, as_of: dt.date, target: DataFrame, lookback_days: int = LOOKBACK_DAYS, loaded_since: dt.date | None = None
) -> DataFrame:
    """Orders that were loaded, or had lines or returns loaded, since the last run (``loaded_since``; without it, since
    the newest load in the table), less the look-back."""
    if loaded_since is None:
        cutoff = target.agg(F.max("_loaded_at")).scalar() - F.expr(f"interval {int(lookback_days)} days")
    else:
        cutoff = _since(loaded_since, lookback_days)
    recent = _orders_among(inputs["raw_orders"], affected_orders(inputs, cutoff))
    return fct_orders(_with_orders(inputs, recent), as_of)


def order_items_increment(
    inputs: Inputs, as_of: dt.date, target: DataFrame, orders: DataFrame, lookback_days: int = LOOKBACK_DAYS, by_order: bool = False
) -> DataFrame:
    """Lines of the orders that were (re)built since the table's newest build, less the look-back."""
    return lines_of_orders(inputs, as_of, since_last(orders, target, "built_at", "built_at", lookback_days), by_order)


def lines_of_orders(inputs: Inputs, as_of: dt.date, orders: DataFrame, by_order: bool = False) -> DataFrame:
    """Lines of some built orders. ``by_order`` for lines that lie by order: they do not move, only pairs of order and product
    go to the products and back."""
    keys = orders.selectExpr("order_id AS _rebuilt")
    lines = inputs["raw_order_items"].join(keys, F.col("order_id") == F.col("_rebuilt"), "left_semi")
    narrowed = {"raw_order_items": lines, "catalog_products": inputs["catalog_products"], "fct_orders": orders}
    if by_order:
        narrowed["order_items_enriched"] = order_items_by_order(narrowed, as_of)
    return fct_order_items(narrowed, as_of)


def store_performance_increment(
    inputs: Inputs,
    as_of: dt.date,
    target: DataFrame,
    first: dt.date,
    lookback_days: int = LOOKBACK_DAYS,
    loaded_since: dt.date | None = None,
) -> DataFrame:
    """Days of the spine to compute again, and the days after the newest one up to ``as_of``.

    With ``loaded_since``, the day of the last run: the store days of all orders that were loaded, or had lines or returns
    loaded, since then less the look-back, however old; only their orders, lines and returns are read. Without it: the last
    days of the spine, so that anything that arrives later than the look-back is lost.
    """
    mark = high_water(target, "order_date")
    if loaded_since is None or mark is None:
        return store_performance(inputs, as_of, max(first, _from(mark, lookback_days, first)))
    orders, next_day = inputs["raw_orders"], max(first, mark + dt.timedelta(days=1))
    affected = _orders_among(orders, affected_orders(inputs, _since(loaded_since, lookback_days)))
    again = affected.filter(f"order_date BETWEEN {day(first)} AND {day(min(mark, as_of))}").select("store_id", "order_date").distinct()
    # Written, its size is known: where store days are few, orders are not dealt out to meet them.
    again = written(again, "store-days")
    stores = inputs["catalog_stores"].filter("is_active").select("store_id", "store_name", "channel", "region")
    spine, built = again.join(stores, "store_id"), _only(orders, again)
    if next_day <= as_of:  # the new days are later than those computed again
        spine = spine.unionByName(store_days(inputs, next_day, as_of))
        built = built.unionByName(orders.filter(f"order_date BETWEEN {day(next_day)} AND {day(as_of)}"))
    return store_performance(_with_orders(inputs, built), as_of, first, spine=spine)


def _first_day_again(target: DataFrame, column: str, lookback_days: int, strictly_after: bool) -> dt.date | None:
    mark = high_water(target, column)
    if mark is None:
        return None
    return mark + dt.timedelta(days=1) if strictly_after else mark - dt.timedelta(days=lookback_days)


def revenue_daily_increment(
    inputs: Inputs,
    as_of: dt.date,
    target: DataFrame,
    lookback_days: int = LOOKBACK_DAYS,
    strictly_after: bool = False,
    loaded_since: dt.date | None = None,
) -> DataFrame:
    """Store days to compute again. With ``loaded_since``, the day of the last run: the days of all orders that were
    loaded, or had lines or returns loaded, since then less the look-back, however old. Without it: days
    from the newest one less the look-back; ``strictly_after`` takes only newer days and so loses late orders
    of days already present."""
    if loaded_since is not None:
        affected = affected_orders(inputs, _since(loaded_since, lookback_days))
        days = _orders_among(inputs["raw_orders"], affected).select("order_date", "store_id").distinct()
        return revenue_daily(_with_orders(inputs, _only(inputs["raw_orders"], days)), as_of)
    start = _first_day_again(target, "revenue_date", lookback_days, strictly_after)
    if start is None:
        return revenue_daily(inputs, as_of)
    recent = f"order_date >= {day(start)}"
    stored = [name for name in ("fct_orders", "fct_order_items") if inputs.get(name) is not None]
    if "fct_orders" in stored:
        return revenue_daily(replaced(inputs, **{name: inputs[name].filter(recent) for name in stored}), as_of)
    return revenue_daily(_with_orders(inputs, inputs["raw_orders"].filter(recent)), as_of)


def campaign_performance_increment(
    inputs: Inputs,
    as_of: dt.date,
    target: DataFrame,
    lookback_days: int = LOOKBACK_DAYS,
    strictly_after: bool = False,
    loaded_since: dt.date | None = None,
) -> DataFrame:
    """Campaign days to compute again, as for revenue; with ``loaded_since`` those of spend and of orders loaded since.
    Otherwise the day filter also reaches the orders, whose day is a join key."""
    if loaded_since is not None:
        cutoff, orders = _since(loaded_since, lookback_days), inputs["raw_orders"]
        campaign, spend = F.expr("bigint(campaign_id)"), inputs["raw_ad_spend"]
        spent = spend.filter(F.col("_loaded_at") >= cutoff).select(campaign.alias("campaign"), F.col("spend_date").alias("spent_on"))
        ordered = _orders_among(orders, affected_orders(inputs, cutoff)).select(campaign.alias("campaign"), F.col("order_date").alias("spent_on"))
        days = written(spent.unionByName(ordered).filter("campaign IS NOT NULL").distinct(), "campaign-days")

        def on_days(df: DataFrame, column: str) -> DataFrame:
            return df.join(days, (campaign == F.col("campaign")) & (F.col(column) == F.col("spent_on")), "left_semi")

        narrowed = _with_orders(inputs, on_days(orders, "order_date"))
        return campaign_performance({**narrowed, "raw_ad_spend": on_days(spend, "spend_date")}, as_of)
    start = _first_day_again(target, "spend_date", lookback_days, strictly_after)
    built = campaign_performance(inputs, as_of)
    return built if start is None else built.filter(f"spend_date >= {day(start)}")


def inventory_increment(
    inputs: Inputs,
    as_of: dt.date,
    target: DataFrame,
    opening: DataFrame,
    first: dt.date,
    lookback_days: int = LOOKBACK_DAYS,
    loaded_since: dt.date | None = None,
) -> DataFrame:
    """Days strictly after the newest one and, with ``loaded_since``, those that later loads change.

    A sale that arrives late lowers the level of its product in its store on every day from its own on. Such a pair is built
    again from the first day of an order loaded, or with lines or returns loaded, since then less the look-back; all other pairs
    only get the new days. Levels go on from the row of the day before in the table, so the run reads the orders since the first day
    of a store's changes. Pairs that the table doesn't have, or with changes before ``first``, start from the opening
    stock and the store's whole history. Without ``loaded_since`` late sales are missed.
    """
    mark = high_water(target, "snapshot_date")
    if loaded_since is None or mark is None:
        return inventory_daily(inputs, as_of, opening, max(first, _from(mark, -1, first)))
    pair, orders = ["product_id", "store_id"], inputs["raw_orders"]
    next_day = max(first, mark + dt.timedelta(days=1))
    affected = use(of_orders(inputs, affected_orders(inputs, _since(loaded_since, lookback_days))), fct_order_items, as_of)
    changes = affected.groupBy(*pair).agg(F.min("order_date").alias("changed_on"))
    held = target.filter(F.col("snapshot_date") == F.lit(mark)).select(*pair, F.lit(True).alias("held"))
    starts = opening.join(changes.hint("merge"), pair, "left").join(held.hint("merge"), pair, "left")
    first_day = f"if(held IS NULL, {day(first)}, greatest({day(first)}, least(changed_on, {day(next_day)})))"
    starts = written(starts.selectExpr(*pair, "opening_units", f"{first_day} AS first_day"), "inventory-starts")
    # A store's orders are needed from the first of its days that is built; the whole history where the opening stock is the start.
    needed = starts.groupBy("store_id").agg(F.min(F.expr(f"if(first_day <= {day(first)}, DATE'0001-01-01', first_day)")).alias("_needed_from"))
    recent = orders.join(needed, "store_id").filter("order_date >= _needed_from").select(*orders.columns)
    moves = written(inventory_movements(_with_orders(inputs, recent), as_of).filter(f"snapshot_date <= {day(as_of)}"), "inventory-moves")
    before = moves.filter(f"snapshot_date < {day(first)}").groupBy(*pair).agg(F.expr("sum(units_sold_today) AS sold_before"))
    earlier = target.selectExpr(*pair, "date_add(snapshot_date, 1) AS first_day", "units_on_hand AS level_before")
    levels = (
        starts.join(before.hint("merge"), pair, "left")
        .join(earlier.hint("merge"), [*pair, "first_day"], "left")
        .selectExpr(*pair, "first_day", f"if(first_day <= {day(first)}, opening_units - {zero_if_null('sold_before')}, level_before) AS start_units")
    )
    return inventory_days(inputs, as_of, levels, moves, as_of)


def channel_attribution_increment(
    inputs: Inputs, as_of: dt.date, target: DataFrame, lookback_days: int = 7, loaded_since: dt.date | None = None
) -> DataFrame:
    """Every touched month, as a whole; the months replace those of the table, so a channel that lost
    its last order of a month goes. With ``loaded_since``: the months of orders that are affected by a load since then less the
    look-back, and those in which an event loaded since then can be a touch; only the orders of these months, their
    lines and returns, and the events that can be touches in them are read. Without it: months from the look-back before
    the newest month."""
    if loaded_since is not None:
        cutoff, orders, events = _since(loaded_since, lookback_days), inputs["raw_orders"], inputs["raw_events"]
        # An event can be a touch in its own month and in those of the following days.
        reach = F.expr(f"explode(sequence({month_start('event_date')}, {month_start(f'date_add(event_date, {TOUCH_DAYS})')}, interval 1 month))")
        own = F.expr(month_start("order_date"))
        touched = _orders_among(orders, affected_orders(inputs, cutoff)).select(own.alias("month"))
        touched = touched.unionByName(events.filter(F.col("_loaded_at") >= cutoff).select(reach.alias("month")))
        months = written(touched.filter("month IS NOT NULL").distinct(), "months")
        narrowed = _with_orders(inputs, orders.join(months, own == F.col("month"), "left_semi"))
        # An event that reaches into two of the months appears twice, which changes no last touch.
        near = events.select("*", reach.alias("_reached")).join(months, F.col("_reached") == F.col("month"), "left_semi").drop("_reached")
        return channel_attribution({**narrowed, "raw_events": near}, as_of)
    mark = high_water(target, "order_month")
    if mark is None:
        return channel_attribution(inputs, as_of)
    start = mark - dt.timedelta(days=lookback_days)
    orders = use(inputs, fct_orders, as_of).filter(f"order_date >= {day(start.replace(day=1))}")
    return channel_attribution({"fct_orders": orders, "raw_events": inputs["raw_events"]}, as_of)
