"""Staging: types, cleaned codes and calendar parts. Projections only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from marketloom.functions.scalars import (
    MONEY,
    cents,
    day_of_week_from_sunday,
    exprs,
    month_start,
    quarter_start,
    ratio,
    week_start,
    whole_ratio,
)
from marketloom.plans.base import Inputs, day


def stg_customers(inputs: Inputs, as_of: dt.date) -> DataFrame:
    return inputs["raw_customers"].selectExpr(
        "customer_id",
        "first_name",
        "last_name",
        "first_name || ' ' || last_name AS full_name",
        "lower(email) AS email",
        "city",
        "state",
        "customer_segment",
        "acquisition_channel",
        "acquisition_date",
        "age",
        "CASE gender WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE 'Unknown' END AS gender",
        "is_email_subscribed",
        "is_sms_subscribed",
        f"{month_start('acquisition_date')} AS acquisition_month",
        f"{quarter_start('acquisition_date')} AS acquisition_quarter",
        "year(acquisition_date) AS acquisition_year",
        f"datediff({day(as_of)}, acquisition_date) AS days_since_acquisition",
        "created_at",
        "updated_at",
    )


def stg_orders(inputs: Inputs, as_of: dt.date) -> DataFrame:
    return inputs["raw_orders"].selectExpr(
        "bigint(order_id) AS order_id",
        "date(order_date) AS order_date",
        "timestamp(ordered_at) AS ordered_at",
        "bigint(customer_id) AS customer_id",
        "bigint(store_id) AS store_id",
        "upper(status) AS order_status",
        f"cast(coalesce(discount_amount, 0) AS {MONEY}) AS discount_amount",
        "payment_method",
        "int(campaign_id) AS campaign_id",
        "traffic_source",
        "item_count",
        "upper(status) = 'COMPLETED' AS is_completed",
        "upper(status) = 'RETURNED' AS is_returned",
        "upper(status) = 'CANCELLED' AS is_cancelled",
        # From the delivered amount: an unknown discount stays unknown here.
        "discount_amount > 0 AS has_discount",
        f"{month_start('order_date')} AS order_month",
        f"{week_start('order_date')} AS order_week",
        f"{day_of_week_from_sunday('order_date')} AS order_day_of_week",
        "month(order_date) AS order_month_num",
        "quarter(order_date) AS order_quarter",
        "year(order_date) AS order_year",
        "timestamp(_loaded_at) AS _loaded_at",
    )


def stg_order_items(inputs: Inputs, as_of: dt.date) -> DataFrame:
    discount = whole_ratio(cents("line_discount"), cents("line_gross_revenue"), 100, 2)
    return inputs["raw_order_items"].selectExpr(
        "bigint(order_item_id) AS order_item_id",
        "bigint(order_id) AS order_id",
        "bigint(product_id) AS product_id",
        "quantity",
        "unit_price_at_purchase",
        "line_gross_revenue",
        "line_net_revenue",
        "line_discount",
        "round(line_gross_revenue - line_net_revenue, 2) AS line_discount_amount",
        f"CASE WHEN line_gross_revenue > 0 THEN {discount} ELSE 0D END AS discount_pct",
        "timestamp(_loaded_at) AS _loaded_at",
    )


def stg_returns(inputs: Inputs, as_of: dt.date, compat: bool = False) -> DataFrame:
    """``compat`` compares the status as delivered, so only upper-case deliveries count as approved."""
    status = "return_status" if compat else "upper(return_status)"
    return inputs["raw_returns"].selectExpr(
        "return_id",
        "bigint(order_id) AS order_id",
        "bigint(customer_id) AS customer_id",
        "bigint(store_id) AS store_id",
        "order_date",
        "return_date",
        "datediff(return_date, order_date) AS days_to_return",
        "return_reason",
        "resolution_type",
        f"cast(refund_amount AS {MONEY}) AS refund_amount",
        "upper(return_status) AS return_status",
        f"{status} = 'APPROVED' AS is_approved",
    )


def _ad_spend(source: DataFrame, click_rate: str, cost_per_click: str, cost_per_order: str) -> DataFrame:
    return source.selectExpr(
        "spend_id",
        "campaign_id",
        "campaign_name",
        "channel",
        "campaign_type",
        "spend_date",
        "spend_usd",
        "impressions",
        "clicks",
        "attributed_orders",
        f"{click_rate} AS click_through_rate_pct",
        f"{cost_per_click} AS cost_per_click",
        f"{cost_per_order} AS cost_per_acquisition",
        f"{week_start('spend_date')} AS spend_week",
        f"{month_start('spend_date')} AS spend_month",
        "quarter(spend_date) AS spend_quarter",
        "year(spend_date) AS spend_year",
        "_loaded_at",
    )


def stg_platform_ad_spend(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """Platform rules: 0 click rate without impressions, cost per click to 4 decimals."""
    return _ad_spend(
        inputs["raw_ad_spend"],
        f"CASE WHEN impressions > 0 THEN {whole_ratio('clicks', 'impressions', 100, 4)} ELSE 0D END",
        f"CASE WHEN clicks > 0 THEN {whole_ratio(cents('spend_usd'), 'clicks * 100', 1, 4)} END",
        f"CASE WHEN attributed_orders > 0 THEN {whole_ratio(cents('spend_usd'), 'attributed_orders * 100', 1, 2)} END",
    )


def stg_ad_spend(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """Marketing rules: unknown click rate without impressions, cost per click to 2 decimals."""
    return _ad_spend(
        inputs["raw_ad_spend"],
        whole_ratio("clicks", "impressions", 100, 4),
        whole_ratio(cents("spend_usd"), "clicks * 100", 1, 2),
        whole_ratio(cents("spend_usd"), "attributed_orders * 100", 1, 2),
    )


def _started(start: str) -> list[str]:
    return [
        f"{month_start(start)} AS campaign_start_month",
        f"quarter({start}) AS campaign_quarter",
        f"year({start}) AS campaign_year",
    ]


def stg_platform_campaigns(inputs: Inputs, as_of: dt.date) -> DataFrame:
    days = "datediff(end_date, start_date) + 1"
    return inputs["catalog_campaigns"].selectExpr(
        "campaign_id",
        "campaign_name",
        "channel",
        "campaign_type",
        "start_date",
        "end_date",
        "budget_usd",
        "target_segment",
        "utm_source",
        "utm_medium",
        "utm_campaign",
        "is_active",
        f"{days} AS campaign_duration_days",
        f"{ratio('budget_usd', days, 1, 2)} AS daily_budget_usd",
        *_started("start_date"),
    )


def stg_campaigns(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """Campaigns as seen in the spend: one grouping instead of a window over every spend row.

    The totals are per campaign id; a campaign whose name or channel changed keeps one row per
    variant, all with the same totals.
    """
    variant = ["campaign_id", "campaign_name", "channel", "campaign_type"]
    per_variant = (
        inputs["raw_ad_spend"]
        .groupBy(*variant)
        .agg(*exprs("min(spend_date) AS first_day", "max(spend_date) AS last_day", "sum(spend_usd) AS spent"))
    )
    totals = per_variant.groupBy("campaign_id").agg(
        *exprs("min(first_day) AS start_date", "max(last_day) AS end_date", "sum(spent) AS budget_usd")
    )
    return (
        per_variant.select(*variant)
        .join(totals, "campaign_id")
        .selectExpr(*variant, "start_date", "end_date", "budget_usd", *_started("start_date"))
    )
