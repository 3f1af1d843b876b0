"""Marketing tables: campaign days, attribution, acquisition."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import exprs, mean_of, month_start, ratio, sum_where, zero_if_null
from marketloom.operators.asof import last_touch
from marketloom.plans.base import Inputs, built_at, use
from marketloom.plans.core import dim_customers, fct_orders
from marketloom.plans.staging import stg_ad_spend

# Event types that count as a touch, and devices.
TOUCH_EVENTS = ["purchase_completed", "checkout_started", "add_to_cart", "product_view"]
DEVICES = ["mobile", "desktop", "tablet"]
LOOKBACK_DAYS = 30
#: Touches of one day: the larger of these values wins.
TOUCH_ORDER = ["session_id", "touch_source", "device_type"]


def campaign_daily(inputs: Inputs, as_of: dt.date) -> DataFrame:
    orders = (
        use(inputs, fct_orders, as_of)
        .filter("campaign_id IS NOT NULL AND is_completed")
        .groupBy("campaign_id", F.expr("order_date AS spend_date"))
        .agg(
            *exprs(
                "count(*) AS orders",
                "sum(gross_revenue) AS gross",
                "sum(net_revenue) AS net",
                "sum(realized_revenue) AS realized",
            )
        )
    )
    net = zero_if_null("net")
    return (
        use(inputs, stg_ad_spend, as_of)
        .join(orders, ["campaign_id", "spend_date"], "left")
        .selectExpr(
            "campaign_id",
            "campaign_name",
            "channel",
            "campaign_type",
            "spend_date",
            "spend_usd",
            "impressions",
            "clicks",
            "attributed_orders AS platform_attributed_orders",
            "click_through_rate_pct",
            "cost_per_click",
            "cost_per_acquisition",
            f"{zero_if_null('orders')} AS matched_orders",
            f"{zero_if_null('gross')} AS attributed_gross_revenue",
            f"{net} AS attributed_net_revenue",
            f"{zero_if_null('realized')} AS attributed_realized_revenue",
            f"{ratio('gross', 'orders')} AS attributed_aov",
            f"CASE WHEN spend_usd > 0 THEN {ratio(net, 'spend_usd', 1, 2)} END AS roas",
            "spend_week",
            "spend_month",
            "spend_quarter",
            "spend_year",
        )
    )


def campaign_performance(inputs: Inputs, as_of: dt.date) -> DataFrame:
    return use(inputs, campaign_daily, as_of).selectExpr(
        "campaign_id", "campaign_name", "channel", "campaign_type", "spend_date", "spend_week", "spend_month",
        "spend_quarter", "spend_year", "spend_usd", "impressions", "clicks", "platform_attributed_orders",
        "matched_orders", "attributed_gross_revenue", "attributed_net_revenue", "attributed_realized_revenue",
        "attributed_aov", "click_through_rate_pct", "cost_per_click", "cost_per_acquisition", "roas",
        """CASE WHEN roas >= 5.0 THEN 'high_performing' WHEN roas >= 2.5 THEN 'efficient'
                WHEN roas >= 1.0 THEN 'break_even' ELSE 'underperforming' END AS roas_tier""",
        built_at(as_of),
    )


def touch_events(inputs: Inputs) -> DataFrame:
    """Events that can earn credit: listed types, any source but direct."""
    return (
        inputs["raw_events"]
        .filter(F.col("event_type").isin(TOUCH_EVENTS))
        .filter("traffic_source <> 'direct'")
        .selectExpr("customer_id", "event_date", "session_id", "traffic_source AS touch_source", "device_type")
    )


def completed_orders(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """The orders that can be credited."""
    columns = ["order_id", "order_date", "customer_id", "gross_revenue", "net_revenue", "realized_revenue", "traffic_source"]
    return use(inputs, fct_orders, as_of).filter("is_completed").select(*columns)


def attribution_touchpoints(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """Completed orders credited to the last touch of the preceding 30 days; equal days go to the
    larger session id, then source and device by name."""
    return credited_touches(
        last_touch(
            completed_orders(inputs, as_of),
            touch_events(inputs),
            key="customer_id",
            event_day="order_date",
            touch_day="event_date",
            order_by=TOUCH_ORDER,
            lookback_days=LOOKBACK_DAYS,
        )
    )


def credited_touches(orders: DataFrame) -> DataFrame:
    """The columns of credited orders, from orders with their last touch."""
    return orders.selectExpr(
        "order_id",
        "order_date",
        "customer_id",
        "gross_revenue",
        "net_revenue",
        "realized_revenue",
        "traffic_source AS order_traffic_source",
        "coalesce(touch_source, traffic_source) AS attributed_channel",
        "last_event_date AS touchpoint_date",
        "device_type",
    )


def channel_attribution(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """Credit per channel and month. The distinct customers spread a heavy channel over its
    customers before it is summed; an order has one credited touch, so orders are plain counts."""
    monthly = (
        use(inputs, attribution_touchpoints, as_of)
        .groupBy("attributed_channel", F.expr(f"{month_start('order_date')} AS order_month"))
        .agg(
            *exprs(
                "count(order_id) AS attributed_orders",
                "sum(gross_revenue) AS attributed_gross_revenue",
                "sum(net_revenue) AS attributed_net_revenue",
                "sum(realized_revenue) AS attributed_realized_revenue",
                f"{mean_of('gross_revenue')} AS attributed_aov",
                "count(DISTINCT customer_id) AS unique_customers",
                *[sum_where(f"device_type = '{d}'", "gross_revenue") + f" AS {d}_revenue" for d in DEVICES],
            )
        )
    )
    share = ratio("mobile_revenue", "attributed_gross_revenue", 100, 2)
    return monthly.selectExpr("*", f"{share} AS mobile_revenue_pct", built_at(as_of))


def customer_acquisition(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """New customers per channel and month (the dimension is unique per customer)."""
    return (
        use(inputs, dim_customers, as_of)
        .groupBy("acquisition_channel", "acquisition_month", "acquisition_quarter", "acquisition_year")
        .agg(
            *exprs(
                "count(customer_id) AS new_customers",
                "sum(lifetime_net_revenue) AS cohort_ltv",
                f"{mean_of('lifetime_net_revenue')} AS avg_cohort_ltv",
                f"{mean_of('total_orders')} AS avg_orders_per_customer",
                "count_if(customer_value_tier = 'high_value') AS high_value_customers",
            )
        )
    )
