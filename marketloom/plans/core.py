"""Core tables: dimensions, order facts, store days, inventory positions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import (
    day_of_week_from_sunday,
    exprs,
    month_start,
    quarter_start,
    ratio,
    sum_where,
    week_start,
    zero_if_null,
)
from marketloom.operators.shape import date_spine
from marketloom.plans.base import Inputs, built_at, day, use
from marketloom.plans.enrich import customers_with_orders, order_items_enriched, orders_enriched
from marketloom.plans.staging import stg_order_items

FIRST_DAY, LAST_DAY = dt.date(2022, 1, 1), dt.date(2027, 12, 31)


def dim_customers(inputs: Inputs, as_of: dt.date) -> DataFrame:
    return use(inputs, customers_with_orders, as_of).selectExpr("*", built_at(as_of))


def _dimension(inputs: Inputs, as_of: dt.date, catalog: str, *columns: str) -> DataFrame:
    return inputs[catalog].selectExpr(*columns, built_at(as_of))


def dim_products(inputs: Inputs, as_of: dt.date) -> DataFrame:
    return _dimension(
        inputs, as_of, "catalog_products", "product_id", "product_name", "sku", "category", "subcategory", "brand",
        "unit_price", "cost_price", "margin_pct", "is_active", "launch_date", "weight_lbs", "is_featured",
    )


def dim_stores(inputs: Inputs, as_of: dt.date) -> DataFrame:
    return _dimension(
        inputs, as_of, "catalog_stores", "store_id", "store_name", "store_type", "channel", "city", "state", "region",
        "opened_date", "sq_footage", "district", "is_active", "manager_name",
    )


def dim_promotions(inputs: Inputs, as_of: dt.date) -> DataFrame:
    return _dimension(
        inputs, as_of, "catalog_promotions", "promotion_id", "promotion_code", "promotion_name", "discount_type",
        "discount_value", "min_order_amount", "start_date", "end_date", "channel", "is_stackable", "max_redemptions",
        "is_active",
    )


def dim_payment_methods(inputs: Inputs, as_of: dt.date) -> DataFrame:
    return _dimension(
        inputs, as_of, "catalog_payment_methods", "payment_method_id", "payment_method", "payment_category",
        "processor", "processing_fee_pct", "supports_refund", "supports_partial_refund", "is_active",
    )


def fiscal_year(d: str) -> str:
    """The fiscal year starts on 1 February."""
    return f"CASE WHEN month({d}) >= 2 THEN year({d}) ELSE year({d}) - 1 END"


def fiscal_month(d: str) -> str:
    return f"CASE WHEN month({d}) >= 2 THEN month({d}) - 1 ELSE month({d}) + 11 END"


def fiscal_quarter(d: str) -> str:
    return f"int(ceil(({fiscal_month(d)}) / 3))"


def _fourth_thursday(d: str) -> str:
    # Thursday is day 4 counted from Sunday = 0.
    first = month_start(d)
    return f"date_add({first}, (4 - {day_of_week_from_sunday(first)} + 7) % 7 + 21)"


def calendar(days: DataFrame, compat: bool = False) -> DataFrame:
    """Calendar columns for a table of ``date_day``.

    Black Friday is the day after the fourth Thursday of November and Cyber Monday three days
    later. ``compat`` keeps the older rule: one weekday further on, and a fixed 1 December.
    """
    d = "date_day"
    if compat:
        first = month_start(d)
        friday = f"date_add({first}, (5 - {day_of_week_from_sunday(first)}) % 7 + 22)"
        cyber_monday = f"month({d}) = 12 AND day({d}) = 1"
    else:
        friday = f"date_add({_fourth_thursday(d)}, 1)"
        thursday = f"date_sub({d}, 4)"  # the fourth Thursday, if the day is Cyber Monday
        cyber_monday = f"month({thursday}) = 11 AND {thursday} = {_fourth_thursday(thursday)}"
    weekday = day_of_week_from_sunday(d)

    def on(month: int, dom: int, name: str) -> str:
        return f"month({d}) = {month} AND day({d}) = {dom} AS {name}"

    return days.selectExpr(
        d,
        f"{weekday} AS day_of_week_num",
        f"dayname({d}) AS day_of_week_name",
        f"day({d}) AS day_of_month",
        f"dayofyear({d}) AS day_of_year",
        f"weekofyear({d}) AS week_of_year",
        f"{week_start(d)} AS week_start_date",
        f"month({d}) AS month_num",
        f"monthname({d}) AS month_name",
        f"{month_start(d)} AS month_start_date",
        f"quarter({d}) AS quarter_num",
        f"'Q' || quarter({d}) AS quarter_name",
        f"{quarter_start(d)} AS quarter_start_date",
        f"year({d}) AS year_num",
        f"{weekday} IN (0, 6) AS is_weekend",
        f"{weekday} NOT IN (0, 6) AS is_weekday",
        f"{fiscal_year(d)} AS fiscal_year",
        f"{fiscal_quarter(d)} AS fiscal_quarter",
        f"{fiscal_month(d)} AS fiscal_month",
        f"month({d}) = 11 AND {d} = {friday} AS is_black_friday",
        f"{cyber_monday} AS is_cyber_monday",
        on(12, 25, "is_christmas"),
        on(1, 1, "is_new_years"),
        on(7, 4, "is_independence_day"),
        on(2, 14, "is_valentines_day"),
        f"""CASE WHEN month({d}) IN (12, 1, 2) THEN 'Winter' WHEN month({d}) IN (3, 4, 5) THEN 'Spring'
                 WHEN month({d}) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season""",
    )


def dim_dates(
    spark: SparkSession, first: dt.date = FIRST_DAY, last: dt.date = LAST_DAY, compat: bool = False
) -> DataFrame:
    """Calendar from ``first`` to ``last`` inclusive (``compat`` adds the one extra day at the end)."""
    end = last + dt.timedelta(days=2 if compat else 1)
    return calendar(date_spine(spark, "day", first, end), compat)


def time_spine(spark: SparkSession, first: dt.date = FIRST_DAY, last: dt.date = LAST_DAY) -> DataFrame:
    return dim_dates(spark, first, last).select("date_day")


def days_covering(df: DataFrame, column: str) -> DataFrame:
    """Every day from the first to the last value of a date column."""
    span = df.agg(*exprs(f"min({column}) AS low", f"max({column}) AS high")).filter("low IS NOT NULL")
    return span.selectExpr("explode(sequence(low, high)) AS date_day")


ORDER_COLUMNS = [
    "order_id", "order_date", "ordered_at", "customer_id", "store_id", "store_name", "store_type", "store_channel",
    "store_city", "store_state", "store_region", "order_status", "is_completed", "is_returned", "is_cancelled",
    "payment_method", "campaign_id", "traffic_source", "has_discount", "order_level_discount", "item_count",
    "order_month", "order_week", "order_quarter", "order_year", "gross_revenue", "net_revenue", "total_units",
    "distinct_products", "estimated_tax", "refund_amount", "return_reason", "return_date", "has_return",
]


def fct_orders(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """Orders with realized revenue: net revenue less the refund of a returned order, at least 0."""
    return use(inputs, orders_enriched, as_of).selectExpr(
        *ORDER_COLUMNS,
        f"""CASE WHEN is_returned AND has_return THEN greatest(net_revenue - {zero_if_null("refund_amount")}, 0)
                 ELSE net_revenue END AS realized_revenue""",
        "_loaded_at",
        built_at(as_of),
    )


def fct_order_items(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """Lines with their order and product. Lines meet their orders first, while they are narrow and lie by order."""
    of_order = [
        "order_date", "order_month", "order_year", "customer_id", "store_id", "store_channel", "traffic_source",
        "campaign_id", "order_status",
    ]
    orders = use(inputs, fct_orders, as_of).select("order_id", *of_order)
    stored = inputs.get("order_items_enriched")
    if stored is None:
        lines = use(inputs, stg_order_items, as_of).join(orders, "order_id")
        items = order_items_enriched(inputs, as_of, lines, of_order)
    else:
        items = stored.join(orders, "order_id")
    return items.selectExpr(
        "order_item_id", "order_id", "order_date", "order_month", "order_year", "customer_id", "store_id",
        "store_channel", "traffic_source", "campaign_id", "order_status", "product_id", "product_name", "sku",
        "category", "subcategory", "brand", "quantity", "unit_price_at_purchase", "cost_price", "line_gross_revenue",
        "line_net_revenue", "line_discount", "discount_pct", "unit_margin", "line_margin", "line_margin_pct",
        "is_featured", "_loaded_at", built_at(as_of),
    )


def store_days(inputs: Inputs, first: dt.date, last: dt.date) -> DataFrame:
    """Active stores × days, one row each: every store unfolds its own run of days."""
    stores = inputs["catalog_stores"].filter("is_active")
    days = f"explode(sequence({day(first)}, {day(last)})) AS order_date"
    return stores.selectExpr("store_id", "store_name", "channel", "region", days)


def store_performance(
    inputs: Inputs, as_of: dt.date, first: dt.date, last: dt.date | None = None, spine: DataFrame | None = None
) -> DataFrame:
    """Store-day performance from ``first`` to ``last`` (at most ``as_of``). ``spine`` limits the result to some store
    days, with the columns of ``store_days``."""
    last = min(last or as_of, as_of)
    in_range = f"order_date BETWEEN {day(first)} AND {day(last)}"
    keys = ["store_id", "order_date"]
    # The distinct count makes Spark group by (store, day, customer) first: a store with a third
    # of all orders is spread over its customers.
    metrics = (
        use(inputs, fct_orders, as_of)
        .filter(in_range)
        .groupBy(*keys)
        .agg(
            *exprs(
                "count(*) AS total_orders",
                "count_if(is_completed) AS completed_orders",
                "count_if(is_returned) AS returned_orders",
                "count(DISTINCT customer_id) AS unique_customers",
                f"{sum_where('is_completed', 'gross_revenue')} AS gross_revenue",
                f"{sum_where('is_completed', 'net_revenue')} AS net_revenue",
                "sum(realized_revenue) AS realized_revenue",
                "sum(refund_amount) AS refund_amount",
            )
        )
    )
    by_category = (
        use(inputs, fct_order_items, as_of)
        .filter(f"{in_range} AND order_status = 'COMPLETED'")
        .groupBy(*keys, "category")
        .agg(F.expr("sum(line_gross_revenue) AS category_gross"))
    )
    # One row per store-day and category; Spark keeps the best row map-side before the shuffle.
    best_first = Window.partitionBy(*keys).orderBy(F.desc("category_gross"), "category")
    top = (
        by_category.withColumn("place", F.row_number().over(best_first))
        .filter("place = 1")
        .selectExpr(*keys, "category AS top_category")
    )
    net = zero_if_null("net_revenue")
    days = store_days(inputs, first, last) if spine is None else spine
    return (
        days.join(metrics, keys, "left")
        .join(top, keys, "left")
        .selectExpr(
            "store_id",
            "order_date",
            "store_name",
            "channel",
            "region",
            f"{zero_if_null('total_orders')} AS total_orders",
            f"{zero_if_null('completed_orders')} AS completed_orders",
            f"{zero_if_null('returned_orders')} AS returned_orders",
            f"{zero_if_null('unique_customers')} AS unique_customers",
            f"{zero_if_null('gross_revenue')} AS gross_revenue",
            f"{net} AS net_revenue",
            f"{zero_if_null('realized_revenue')} AS realized_revenue",
            f"{zero_if_null('refund_amount')} AS refund_amount",
            "top_category",
            f"coalesce({ratio('gross_revenue', 'completed_orders')}, 0D) AS average_order_value",
            f"coalesce({ratio('returned_orders', 'total_orders', 100)}, 0D) AS return_rate_pct",
            f"""CASE WHEN {net} >= 10000 THEN 'A' WHEN {net} >= 5000 THEN 'B'
                     WHEN {net} >= 1000 THEN 'C' ELSE 'D' END AS performance_tier""",
            built_at(as_of),
        )
    )


# Inventory. Levels come from an opening-stock table (product_id, store_id, opening_units) and
# from completed order lines.


def inventory_movements(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """Units sold per product, store and day (completed orders)."""
    return (
        use(inputs, fct_order_items, as_of)
        .filter("order_status = 'COMPLETED'")
        .groupBy("product_id", "store_id", F.expr("order_date AS snapshot_date"))
        .agg(F.expr("sum(quantity) AS units_sold_today"))
    )


def _to_date() -> Window:
    timeline = Window.partitionBy("product_id", "store_id").orderBy("snapshot_date")
    return timeline.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def inventory_positions(inputs: Inputs, as_of: dt.date, opening: DataFrame) -> DataFrame:
    """Stock level after each day with sales, valid until the day before the next one.

    One row per product, store and *selling* day; a level that does not change is a validity
    range, not a row per day. The running sum is over days of one product in one store, at
    most one row per calendar day, whatever the sales volume.
    """
    moves = inventory_movements(inputs, as_of)
    timeline = Window.partitionBy("product_id", "store_id").orderBy("snapshot_date")
    return (
        moves.withColumns(
            {"sold": F.sum("units_sold_today").over(_to_date()), "next_day": F.lead("snapshot_date").over(timeline)}
        )
        .join(opening, ["product_id", "store_id"])
        .selectExpr(
            "product_id",
            "store_id",
            "snapshot_date",
            "date_sub(next_day, 1) AS valid_until",
            "opening_units - sold AS units_on_hand",
            "units_sold_today",
        )
    )


def inventory_daily(
    inputs: Inputs, as_of: dt.date, opening: DataFrame, first: dt.date, last: dt.date | None = None
) -> DataFrame:
    """Daily stock per stocked product, active store and day from ``first`` to ``last``.

    Pairs of product and store are those of the opening-stock table. Every pair unfolds the
    requested days; sales before ``first`` only lower the starting level.
    """
    last = min(last or as_of, as_of)
    pair = ["product_id", "store_id"]
    moves = inventory_movements(inputs, as_of).filter(f"snapshot_date <= {day(last)}")
    before = moves.filter(f"snapshot_date < {day(first)}").groupBy(*pair).agg(F.expr("sum(units_sold_today) AS sold_before"))
    levels = opening.join(before.hint("merge"), pair, "left").withColumns(
        {"start_units": F.expr(f"opening_units - {zero_if_null('sold_before')}"), "first_day": F.expr(day(first))}
    )
    return inventory_days(inputs, as_of, levels, moves, last)


def inventory_days(inputs: Inputs, as_of: dt.date, levels: DataFrame, moves: DataFrame, last: dt.date) -> DataFrame:
    """Daily stock from each pair's own ``first_day``, before which it had ``start_units``, to ``last``. Pairs whose first day
    is later than that have no rows; neither have closed stores. Sides that grow with the pairs are merged: their files are
    far smaller than the rows that a broadcast would collect."""
    pair = ["product_id", "store_id"]
    stores = inputs["catalog_stores"].filter("is_active").select("store_id", "store_name", "store_type", "region")
    products = inputs["catalog_products"].select("product_id", "product_name", "category", "cost_price")
    # A pair brings its moves along as one row, at most an entry for each calendar day, and unfolds its days only after the
    # last join: the days are never dealt out.
    of_pair = moves.filter("snapshot_date IS NOT NULL").groupBy(*pair).agg(
        F.expr("collect_list(struct(snapshot_date, units_sold_today)) AS sold_days")
    )
    sold = "map_from_entries(filter(sold_days, x -> x.snapshot_date >= first_day))"
    spine = (
        levels.filter(f"first_day <= {day(last)}")
        .join(stores, "store_id")
        .join(products, "product_id")
        .join(of_pair.hint("merge"), pair, "left")
        .withColumn("sold_days", F.expr(sold))
        .selectExpr("*", f"explode(sequence(first_day, {day(last)})) AS snapshot_date")
        .withColumn("units_sold_today", F.expr("try_element_at(sold_days, snapshot_date)"))
    )
    return (
        spine
        .withColumn("sold", F.sum("units_sold_today").over(_to_date()))
        .withColumn("units_on_hand", F.expr(f"start_units - {zero_if_null('sold')}"))
        .selectExpr(
            "product_id",
            "product_name",
            "category",
            "cost_price",
            "store_id",
            "store_name",
            "store_type",
            "region",
            "snapshot_date",
            "units_on_hand",
            f"{zero_if_null('units_sold_today')} AS units_sold_today",
            """(store_type = 'physical' AND units_on_hand < 30) OR (store_type = 'digital' AND units_on_hand < 200)
               AS is_below_reorder_point""",
            built_at(as_of),
        )
    )
