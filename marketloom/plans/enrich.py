"""Enrichment: order totals, product margins and customer histories."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import cents, exprs, ratio, sum_where, whole_ratio, zero_if_null
from marketloom.operators.sketches import combined_values, frequent_values, top_values
from marketloom.plans.base import Inputs, day, use
from marketloom.plans.staging import stg_customers, stg_order_items, stg_orders, stg_returns

TAX_RATE = "0.085"


def orders_enriched(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """One row per order. Lines and returns are summed per order before the joins, so an order
    with several approved returns stays one row (refunds added up, latest return shown)."""
    # The distinct products are the last place among the products of an order (NULL, if there, has the first one), so that
    # lines are dealt once, by order. Where the count is not asked for, the places go and lines are summed in the map task.
    lines = (
        use(inputs, stg_order_items, as_of)
        .selectExpr("*", "dense_rank() OVER (PARTITION BY order_id ORDER BY product_id) AS place")
        .groupBy("order_id")
        .agg(
            *exprs(
                "sum(line_gross_revenue) AS gross",
                "sum(line_net_revenue) AS net",
                "sum(quantity) AS units",
                "bigint(max(place) - max(if(product_id IS NULL, 1, 0))) AS products",
            )
        )
    )
    returns = (
        use(inputs, stg_returns, as_of)
        .filter("is_approved")
        .groupBy("order_id")
        .agg(
            *exprs(
                "sum(refund_amount) AS refund_amount",
                "max(struct(return_date, return_id, return_reason)) AS latest",
            )
        )
    )
    stores = inputs["catalog_stores"].select(
        "store_id", "store_name", "store_type", "channel", "city", "state", "region"
    )
    net = zero_if_null("net")
    # Stores come first, while orders are narrow; afterwards orders lie by order, as whoever joins or stores them asks.
    return (
        use(inputs, stg_orders, as_of)
        .join(stores, "store_id", "left")
        .join(lines, "order_id", "left")
        .join(returns, "order_id", "left")
        .selectExpr(
            "order_id",
            "order_date",
            "ordered_at",
            "customer_id",
            "store_id",
            "store_name",
            "store_type",
            "channel AS store_channel",
            "city AS store_city",
            "state AS store_state",
            "region AS store_region",
            "order_status",
            "is_completed",
            "is_returned",
            "is_cancelled",
            "payment_method",
            "campaign_id",
            "traffic_source",
            "has_discount",
            "discount_amount AS order_level_discount",
            "item_count",
            "order_month",
            "order_week",
            "order_quarter",
            "order_year",
            f"{zero_if_null('gross')} AS gross_revenue",
            f"{net} AS net_revenue",
            f"{zero_if_null('units')} AS total_units",
            f"{zero_if_null('products')} AS distinct_products",
            f"CASE WHEN is_completed THEN round({net} * {TAX_RATE}, 2) ELSE 0 END AS estimated_tax",
            "refund_amount",
            "latest.return_reason AS return_reason",
            "latest.return_date AS return_date",
            "refund_amount IS NOT NULL AS has_return",
            "_loaded_at",
        )
    )


PRODUCT_COLUMNS = ["product_id", "product_name", "sku", "category", "subcategory", "brand", "cost_price", "is_featured"]


def order_items_enriched(inputs: Inputs, as_of: dt.date, lines: DataFrame | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """Lines with their product. ``lines`` replaces the staged lines and may bring columns of other tables, ``carried``
    to the result: narrow lines that met their orders first are dealt by order once, and only then by product."""
    items = use(inputs, stg_order_items, as_of) if lines is None else lines
    return _with_margins(items.join(inputs["catalog_products"].select(*PRODUCT_COLUMNS), "product_id", "left"), carried)


def order_items_by_order(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """The rows of ``order_items_enriched`` with an order, lying by order, and ``product_copy``: 1 in one row of each line, for products
    that the catalogue has several times. Lines are dealt once, by order. Only pairs of order and product go to the products,
    and come back with these; where ``spark.sql.requireAllClusterKeysForCoPartition`` is off, lines do not move for them."""
    items = use(inputs, stg_order_items, as_of).filter("order_id IS NOT NULL")
    copy = "row_number() OVER (PARTITION BY product_id ORDER BY product_id) AS product_copy"
    products = inputs["catalog_products"].select(*PRODUCT_COLUMNS).filter("product_id IS NOT NULL").selectExpr("*", copy)
    # Dealt by product, equal pairs lie together: an order with many lines of a product asks for it once.
    asked = items.select("order_id", "product_id").filter("product_id IS NOT NULL").repartition("product_id").distinct()
    found = asked.join(products, "product_id")
    met = items.join(found, ["order_id", "product_id"], "left").withColumn("product_copy", F.expr("coalesce(product_copy, 1)"))
    return _with_margins(met, ["product_copy"])


def _with_margins(lines: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    price, margin = "unit_price_at_purchase", "(unit_price_at_purchase - cost_price)"
    return lines.selectExpr(
        "order_item_id",
        "order_id",
        "product_id",
        "product_name",
        "sku",
        "category",
        "subcategory",
        "brand",
        "quantity",
        "unit_price_at_purchase",
        "cost_price",
        "line_gross_revenue",
        "line_net_revenue",
        "line_discount",
        "discount_pct",
        f"round({margin}, 2) AS unit_margin",
        f"round({margin} * quantity, 2) AS line_margin",
        f"CASE WHEN {price} > 0 THEN {whole_ratio(cents(margin), cents(price), 100, 2)} ELSE 0D END AS line_margin_pct",
        "is_featured",
        "_loaded_at",
        *carried,
    )


def customer_order_totals(orders: DataFrame) -> DataFrame:
    """Per-customer totals in two levels, (customer, channel) then customer.

    The first level gives the distinct channels and the most frequent one (ties by name)
    without a distinct aggregate or a window, and keeps a heavy customer's rows map-side.
    """
    per_channel = orders.groupBy("customer_id", "traffic_source").agg(
        *exprs(
            "count(*) AS n",
            "count_if(is_completed) AS completed",
            "count_if(is_returned) AS returned",
            "count_if(is_cancelled) AS cancelled",
            f"{sum_where('is_completed', 'gross_revenue')} AS gross",
            f"{sum_where('is_completed', 'net_revenue')} AS net",
            "min(order_date) AS first_day",
            "max(order_date) AS last_day",
        )
    )
    return per_channel.groupBy("customer_id").agg(
        *exprs(
            "sum(n) AS total_orders",
            "sum(completed) AS completed_orders",
            "sum(returned) AS returned_orders",
            "sum(cancelled) AS cancelled_orders",
            "sum(gross) AS lifetime_gross_revenue",
            "sum(net) AS lifetime_net_revenue",
            f"{ratio('sum(gross)', 'sum(completed)')} AS avg_order_value",
            "min(first_day) AS first_order_date",
            "max(last_day) AS last_order_date",
            "count(traffic_source) AS distinct_channels_used",
            # Among equally frequent channels the smallest name has the smallest (-n, name).
            "min(CASE WHEN traffic_source IS NOT NULL THEN struct(-n AS n, traffic_source AS name) END).name"
            " AS most_common_channel",
        )
    )


def customers_with_orders(inputs: Inputs, as_of: dt.date) -> DataFrame:
    totals = customer_order_totals(use(inputs, orders_enriched, as_of))
    value = zero_if_null("lifetime_net_revenue")
    return (
        use(inputs, stg_customers, as_of)
        .join(totals, "customer_id", "left")
        .selectExpr(
            "customer_id",
            "first_name",
            "last_name",
            "full_name",
            "email",
            "city",
            "state",
            "customer_segment",
            "acquisition_channel",
            "acquisition_date",
            "acquisition_month",
            "acquisition_quarter",
            "acquisition_year",
            "age",
            "gender",
            "is_email_subscribed",
            "is_sms_subscribed",
            "days_since_acquisition",
            f"{zero_if_null('total_orders')} AS total_orders",
            f"{zero_if_null('completed_orders')} AS completed_orders",
            f"{zero_if_null('returned_orders')} AS returned_orders",
            f"{zero_if_null('cancelled_orders')} AS cancelled_orders",
            f"{zero_if_null('lifetime_gross_revenue')} AS lifetime_gross_revenue",
            f"{value} AS lifetime_net_revenue",
            "avg_order_value",
            "first_order_date",
            "last_order_date",
            "datediff(last_order_date, first_order_date) AS days_between_first_last_order",
            f"{zero_if_null('distinct_channels_used')} AS distinct_channels_used",
            "most_common_channel",
            f"""CASE WHEN completed_orders IS NULL THEN 'never_purchased'
                     WHEN last_order_date >= date_sub({day(as_of)}, 90) THEN 'active'
                     WHEN last_order_date >= date_sub({day(as_of)}, 180) THEN 'at_risk'
                     ELSE 'churned' END AS customer_lifecycle_stage""",
            f"""CASE WHEN {value} >= 1000 THEN 'high_value'
                     WHEN {value} >= 300 THEN 'mid_value'
                     WHEN {value} > 0 THEN 'low_value'
                     ELSE 'no_purchases' END AS customer_value_tier""",
        )
    )


def channel_sketches(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """Per customer and month a sketch of the channels of the orders; months are kept and combined, never read again."""
    return frequent_values(use(inputs, orders_enriched, as_of), ["customer_id", "order_month"], "traffic_source")


def customer_channels(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """The estimated most common channel of every customer with orders, with the error of its count."""
    whole = combined_values(use(inputs, channel_sketches, as_of), ["customer_id"])
    return top_values(whole, ["customer_id"], "most_common_channel")
