"""Incremental runs end in the full result; streams keep late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.operators.upsert import KeyedTable
from marketloom.plans import core, finance, increments, marketing
from marketloom.session import fresh_path
from marketloom.streaming import flows
from tests.conftest import rows
from tests.test_pipelines import AS_OF, inputs  # noqa: F401


def test_orders_in_any_split(spark, inputs):  # noqa: F811
    full = rows(core.fct_orders(inputs, AS_OF).select("order_id", "net_revenue", "refund_amount", "order_status"))
    for cuts in (["2026-06-11", "2026-07-01"], ["2026-03-01", "2026-06-11", "2026-06-11", "2026-07-01", "2026-07-01"]):
        table = KeyedTable(spark, fresh_path(spark, "orders"), ["order_id"], "order_month")
        for cut in cuts:
            seen = {**inputs, "raw_orders": inputs["raw_orders"].filter(f"_loaded_at < DATE'{cut}'")}
            table.upsert(increments.orders_increment(seen, AS_OF, table.read()) if table.exists() else core.fct_orders(seen, AS_OF))
        assert rows(table.read().select("order_id", "net_revenue", "refund_amount", "order_status")) == full


def late(inputs, moves):  # noqa: F811
    """The inputs with later load times: table -> condition of the rows that arrive on 1 August."""
    out = dict(inputs)
    for name, condition in moves.items():
        when = F.when(F.expr(condition), F.lit("2026-08-01").cast("timestamp")).otherwise(F.col("_loaded_at"))
        out[name] = inputs[name].withColumn("_loaded_at", when)
    return out


@pytest.mark.parametrize(
    "moves",
    [{"raw_order_items": "order_item_id % 2 = 0"}, {"raw_returns": "true"}, {"raw_order_items": "true", "raw_returns": "return_id % 2 = 1"}],
)
def test_late_lines_and_returns(spark, inputs, moves):  # noqa: F811
    source = late(inputs, moves)
    orders = KeyedTable(spark, fresh_path(spark, "orders"), ["order_id"], "order_month")
    items = KeyedTable(spark, fresh_path(spark, "items"), ["order_item_id"], "order_month")
    days = KeyedTable(spark, fresh_path(spark, "days"), ["revenue_date", "store_id"], "order_month", keys_stay=True)
    for run, cut in enumerate(["2026-06-11", "2026-07-20", "2026-07-20", "2026-09-01"]):
        seen = {**source, **{name: source[name].filter(f"_loaded_at < DATE'{cut}'") for name in increments.ORDER_TABLES}}
        at, since = AS_OF + dt.timedelta(days=run), orders.mark() and dt.date.fromisoformat(orders.mark())
        if since:
            orders.upsert(increments.orders_increment(seen, at, orders.read(), loaded_since=since), mark=cut)
            items.upsert(increments.order_items_increment(seen, at, items.read(), orders.read()))
            days.upsert(increments.revenue_daily_increment(seen, at, days.read(), loaded_since=since))
        else:
            orders.upsert(core.fct_orders(seen, at), mark=cut)
            items.upsert(core.fct_order_items({**seen, "fct_orders": orders.read()}, at))
            days.upsert(finance.revenue_daily(seen, at))
    numbers = ["order_id", "net_revenue", "refund_amount", "order_status"]
    assert rows(orders.read(), *numbers) == rows(core.fct_orders(inputs, AS_OF), *numbers)
    assert rows(items.read(), "order_item_id", "order_id") == rows(core.fct_order_items(inputs, AS_OF), "order_item_id", "order_id")
    columns = [c for c in finance.revenue_daily(inputs, AS_OF).columns if c != "built_at"]
    assert rows(days.read(), *columns) == rows(finance.revenue_daily(inputs, AS_OF), *columns)


@pytest.mark.parametrize("moves", [{"raw_returns": "true"}, {"raw_order_items": "order_id = 13", "raw_orders": "order_id = 15"}])
def test_store_days_follow_what_comes_late(spark, inputs, moves):  # noqa: F811
    source, first = late(inputs, moves), dt.date(2026, 1, 30)
    table = KeyedTable(spark, fresh_path(spark, "store_days"), ["store_id", "order_date"], "month", "string", keys_stay=True)
    for cut in ["2026-06-11", "2026-07-20", "2026-07-20", "2026-08-02"]:
        seen = {**source, **{name: source[name].filter(f"_loaded_at < DATE'{cut}'") for name in increments.ORDER_TABLES}}
        at = dt.date.fromisoformat(cut) - dt.timedelta(days=1)
        if table.exists():
            since = dt.date.fromisoformat(table.mark())
            part = increments.store_performance_increment(seen, at, table.read(), first, loaded_since=since)
        else:
            part = core.store_performance(seen, at, first)
        table.upsert(part.withColumn("month", F.date_format("order_date", "yyyy-MM")), mark=cut)
    whole = core.store_performance(inputs, AS_OF, first).drop("built_at")
    assert rows(table.read(), *whole.columns) == rows(whole)
    days = (AS_OF - first).days + 1
    assert table.read().count() == 2 * days  # two active stores
    # The last run computed the days after the third one, and the old days of what came late.
    old = {r.order_date for r in part.filter("order_date < DATE'2026-07-20'").collect()}
    assert old == ({dt.date(2026, 6, 10), dt.date(2026, 6, 11)} if "raw_returns" in moves else {dt.date(2026, 2, 1), dt.date(2026, 6, 10)})


def shops(spark):
    """Orders of three customers around the ends of months, and their touches."""
    orders = [(1, "2026-01-31", 1), (2, "2026-02-01", 1), (3, "2026-03-02", 2), (4, "2026-03-31", 3), (5, "2026-05-01", 3)]
    touches = [(1, 1, "2026-01-02", "a", 1), (2, 1, "2026-01-31", "b", 40), (3, 2, "2026-01-31", "c", 2), (4, 3, "2026-03-01", "a", 70), (5, 3, "2026-04-02", "d", 90)]
    d, at = dt.date.fromisoformat, lambda text: dt.datetime.combine(dt.date.fromisoformat(text), dt.time(1))
    from marketloom.sources.schemas import ALL

    made = [(i, d(day), c, 1, "completed", None, "card", 7, "direct", 1, at(day), at(day)) for i, day, c in orders]
    lines = [(i, i, 100, 1, i, i, i, 0, at(day)) for i, day, _ in orders]
    lines = [(a, b, c, q, *[__import__("decimal").Decimal(x) for x in (u, g, n, z)], t) for a, b, c, q, u, g, n, z, t in lines]
    events = [
        (i, c, d(day), "product_view", source, "mobile", 100, f"s{i}", dt.datetime(2026, 1, 1) + dt.timedelta(days=loaded))
        for i, c, day, source, loaded in touches
    ]
    return {
        "raw_orders": spark.createDataFrame(made, ALL["raw_orders"]),
        "raw_order_items": spark.createDataFrame(lines, ALL["raw_order_items"]),
        "raw_events": spark.createDataFrame(events, ALL["raw_events"]),
    }


def test_attribution_over_the_ends_of_months(spark, inputs):  # noqa: F811
    source = {**inputs, **shops(spark)}
    table = KeyedTable(spark, fresh_path(spark, "months"), ["attributed_channel", "order_month"], "order_month", keys_stay=True)
    touched = []
    for cut in ["2026-02-02", "2026-02-12", "2026-03-20", "2026-05-02"]:
        seen = {**source, **{n: source[n].filter(f"_loaded_at < DATE'{cut}'") for n in (*increments.ORDER_TABLES, "raw_events")}}
        if table.exists():
            since = dt.date.fromisoformat(table.mark())
            part = increments.channel_attribution_increment(seen, AS_OF, table.read(), lookback_days=0, loaded_since=since)
        else:
            part = marketing.channel_attribution(seen, AS_OF)
        touched.append(sorted({r.order_month.month for r in part.select("order_month").collect()}))
        table.upsert(part, mark=cut, whole_partitions=True)
    whole = marketing.channel_attribution(source, AS_OF).drop("built_at")
    assert rows(table.read(), *whole.columns) == rows(whole)
    # The touch of 31 January came late: January and February; that of 1 March came late as well: March and later ones.
    assert touched[0] == [1, 2] and touched[1] == [1, 2] and 1 not in touched[3]


def test_campaign_days_follow_late_orders_and_spend(spark, inputs):  # noqa: F811
    source = late(inputs, {"raw_returns": "true", "raw_ad_spend": "spend_date = DATE'2026-06-12'"})
    table = KeyedTable(spark, fresh_path(spark, "campaigns"), ["campaign_id", "spend_date"], "spend_month", keys_stay=True)
    names = (*increments.ORDER_TABLES, "raw_ad_spend")
    for cut in ["2026-06-12", "2026-07-20", "2026-09-01"]:
        seen = {**source, **{name: source[name].filter(f"_loaded_at < DATE'{cut}'") for name in names}}
        if table.exists():
            since = dt.date.fromisoformat(table.mark())
            table.upsert(increments.campaign_performance_increment(seen, AS_OF, table.read(), loaded_since=since), mark=cut)
        else:
            table.upsert(marketing.campaign_performance(seen, AS_OF), mark=cut)
    whole = marketing.campaign_performance(inputs, AS_OF).drop("built_at")
    assert rows(table.read(), *whole.columns) == rows(whole)


def test_late_order_inside_and_outside_the_lookback(inputs):  # noqa: F811
    built = finance.revenue_daily(inputs, AS_OF)
    target = built.filter("revenue_date <= DATE'2026-06-10'")
    day = lambda df: [r[0] for r in rows(df.select("revenue_date").distinct())]
    assert day(increments.revenue_daily_increment(inputs, AS_OF, target)) == [dt.date(2026, 6, 10), dt.date(2026, 6, 11)]
    assert day(increments.revenue_daily_increment(inputs, AS_OF, target, strictly_after=True)) == [dt.date(2026, 6, 11)]
    far = increments.revenue_daily_increment(inputs, AS_OF, target, lookback_days=200)
    assert day(far)[0] == dt.date(2026, 2, 1)
    assert increments.revenue_daily_increment(inputs, AS_OF, target.filter("false")).count() == built.count()
    stored = {**inputs, "fct_orders": core.fct_orders(inputs, AS_OF)}
    assert rows(increments.revenue_daily_increment(stored, AS_OF, target)) == rows(
        built.filter("revenue_date >= DATE'2026-06-07'")
    )


def test_only_new_inventory_days(spark, inputs):  # noqa: F811
    opening = spark.createDataFrame([(100, 1, 31)], "product_id long, store_id long, opening_units long")
    first = dt.date(2026, 6, 8)
    whole = core.inventory_daily(inputs, dt.date(2026, 6, 12), opening, first)
    part = core.inventory_daily(inputs, dt.date(2026, 6, 9), opening, first)
    more = increments.inventory_increment(inputs, dt.date(2026, 6, 12), part, opening, first)
    columns = "snapshot_date", "units_on_hand", "units_sold_today"
    assert rows(part.select(*columns).union(more.select(*columns))) == rows(whole.select(*columns))
    assert more.agg({"snapshot_date": "min"}).first()[0] == dt.date(2026, 6, 10)


@pytest.mark.parametrize("moves", [{"raw_order_items": "order_item_id % 2 = 0"}, {"raw_orders": "order_date < DATE'2026-06-09'"}, {"raw_returns": "true"}])
def test_stock_levels_follow_what_comes_late(spark, inputs, moves):  # noqa: F811
    source, first, last = late(inputs, moves), dt.date(2026, 6, 9), dt.date(2026, 8, 3)
    pairs = core.inventory_movements(inputs, AS_OF).select("product_id", "store_id").distinct()
    opening = pairs.withColumn("opening_units", F.expr("30 + product_id % 7"))
    table = KeyedTable(spark, fresh_path(spark, "inventory"), ["product_id", "store_id", "snapshot_date"], "month", "string", keys_stay=True)
    for cut in ["2026-06-11", "2026-07-20", "2026-07-20", "2026-08-04"]:
        seen = {**source, **{name: source[name].filter(f"_loaded_at < DATE'{cut}'") for name in increments.ORDER_TABLES}}
        at = dt.date.fromisoformat(cut) - dt.timedelta(days=1)
        if table.exists():
            since = dt.date.fromisoformat(table.mark())
            part = increments.inventory_increment(seen, at, table.read(), opening, first, loaded_since=since)
        else:  # one pair is not stocked yet
            part = core.inventory_daily(seen, at, opening.filter("product_id <> 100 OR store_id <> 1"), first)
        table.upsert(part.withColumn("month", F.date_format("snapshot_date", "yyyy-MM")), mark=cut)
    whole = core.inventory_daily(inputs, last, opening, first).drop("built_at")
    assert whole.count() > 0 and rows(table.read(), *whole.columns) == rows(whole)
    if "raw_order_items" in moves:  # each pair is built from the first day of an order with late lines, not from the start
        lines = core.fct_order_items(inputs, AS_OF)
        touched = lines.join(lines.filter("order_item_id % 2 = 0").select("order_id").distinct(), "order_id")
        wanted = touched.groupBy("product_id", "store_id").agg(F.expr(f"greatest(min(order_date), DATE'{first}')"))
        assert rows(part.groupBy("product_id", "store_id").agg(F.min("snapshot_date"))) == rows(wanted.join(whole, ["product_id", "store_id"], "left_semi"))


@pytest.fixture
def arrivals(spark):
    """A folder that files are added to, one per call."""
    path = fresh_path(spark, "arrivals")

    def add(*data):
        spark.createDataFrame(list(data), "k long, ts timestamp, v long").coalesce(1).write.mode("append").parquet(path)

    return path, add


def test_stream_upserts_newest_row(spark, arrivals):
    path, add = arrivals
    t = lambda h: dt.datetime(2026, 1, 1, h)
    table = KeyedTable(spark, fresh_path(spark, "latest"), ["k"], "d")
    offsets = fresh_path(spark, "offsets")

    def run():
        source = flows.read_stream(spark, path, "k long, ts timestamp, v long", files_per_trigger=1).selectExpr("*", "date(ts) AS d")
        flows.upsert_stream(source, table, ["ts", "v"], offsets).awaitTermination()
        return rows(table.read().select("k", "v"))

    add((1, t(1), 10), (2, t(1), 20), (1, t(2), 11))
    assert run() == [(1, 11), (2, 20)]
    add((2, t(5), 21), (3, t(5), 30))
    assert run() == [(1, 11), (2, 21), (3, 30)]
    assert run() == [(1, 11), (2, 21), (3, 30)]


def test_an_older_row_in_a_later_batch_loses(spark, arrivals):
    path, add = arrivals
    table = KeyedTable(spark, fresh_path(spark, "latest"), ["k"], "k", "bigint", keys_stay=True)
    for days in ([10, 4], [2], [11], [7, 11]):
        add(*[(k, dt.datetime(2026, 1, d), 100 * d + k) for k, d in enumerate(days)])
        source = flows.read_stream(spark, path, "k long, ts timestamp, v long", files_per_trigger=1)
        flows.upsert_stream(source, table, ["ts"], f"{path}-offsets").awaitTermination()
    assert rows(table.read(), "k", "v") == [(0, 1100), (1, 1101)]


def test_stream_daily_totals_take_late_rows(spark, arrivals):
    path, add = arrivals
    t = lambda d, h=0: dt.datetime(2026, 1, d, h)
    table = KeyedTable(spark, fresh_path(spark, "days"), ["k", "day"], "day")
    offsets = fresh_path(spark, "offsets")

    def run():
        source = flows.read_stream(spark, path, "k long, ts timestamp, v long")
        daily = flows.daily_totals(source, "ts", ["k"], ["count(*) AS n", "sum(v) AS total"])
        flows.maintain_daily_totals(daily, table, offsets).awaitTermination()
        return rows(table.read().select("k", "day", "n", "total"))

    d = lambda n: dt.date(2026, 1, n)
    add((1, t(10), 5), (1, t(10, 9), 6))
    assert run() == [(1, d(10), 2, 11)]
    add((1, t(9, 3), 1), (1, t(11), 2))  # one day late
    assert run() == [(1, d(9), 1, 1), (1, d(10), 2, 11), (1, d(11), 1, 2)]
    add((1, t(10, 5), 4), (1, t(2), 100))  # late inside, and far outside the watermark
    assert run() == [(1, d(9), 1, 1), (1, d(10), 3, 15), (1, d(11), 1, 2)]
