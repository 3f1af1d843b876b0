"""The metric catalogue, the saved metric queries, and the measures of the three star views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame

from marketloom.functions.scalars import mean_of, ratio
from marketloom.operators.metrics import Derived, Entity, Fact, Metrics, Ratio, Simple
from marketloom.plans.base import Inputs, use
from marketloom.plans.core import calendar, days_covering, dim_customers, dim_stores, fct_orders
from marketloom.plans.finance import cohort_analysis, customer_ltv, revenue_daily
from marketloom.plans.marketing import campaign_performance, channel_attribution

FACTS = {
    "fct_orders": Fact(
        "order_date",
        {
            "customers": Entity("dim_customers", "customer_id", "customer_id"),
            "stores": Entity("dim_stores", "store_id", "store_id"),
            "dates": Entity("dim_dates", "order_date", "date_day"),
        },
    ),
    "dim_customers": Fact("acquisition_month"),
    "revenue_daily": Fact("revenue_date"),
    "customer_ltv": Fact("acquisition_month"),
    "cohort_analysis": Fact("cohort_month"),
    "campaign_performance": Fact("spend_date"),
    "channel_attribution": Fact("order_month"),
}

METRICS = {
    "total_gross_revenue": Simple("fct_orders", "sum", "gross_revenue"),
    "total_net_revenue": Simple("fct_orders", "sum", "net_revenue"),
    "realized_revenue": Simple("fct_orders", "sum", "realized_revenue"),
    "discount_amount": Simple("fct_orders", "sum", "order_level_discount"),
    "refund_amount": Simple("fct_orders", "sum", "refund_amount"),
    "order_count": Simple("fct_orders", "count", "order_id"),
    "completed_order_count": Simple("fct_orders", "sum", "CASE WHEN is_completed THEN 1 ELSE 0 END"),
    "returned_order_count": Simple("fct_orders", "sum", "CASE WHEN is_returned THEN 1 ELSE 0 END"),
    "total_units_sold": Simple("fct_orders", "sum", "total_units"),
    "return_rate": Ratio("returned_order_count", "order_count"),
    "average_order_value": Ratio("total_gross_revenue", "completed_order_count"),
    "discount_rate": Ratio("discount_amount", "total_gross_revenue"),
    "revenue_mom_growth": Derived(
        "double({total_net_revenue} - {total_net_revenue@1}) / nullif(double({total_net_revenue@1}), 0D)"
    ),
    "total_customers": Simple("dim_customers", "count", "customer_id"),
    "active_customers": Simple("dim_customers", "sum", "CASE WHEN customer_lifecycle_stage = 'active' THEN 1 ELSE 0 END"),
    "average_customer_ltv": Simple("dim_customers", "average", "lifetime_net_revenue"),
    "total_customer_ltv": Simple("dim_customers", "sum", "lifetime_net_revenue"),
    "avg_order_count_per_customer": Simple("dim_customers", "average", "total_orders"),
    "customer_retention_rate": Ratio("active_customers", "total_customers"),
    "finance_gross_revenue": Simple("revenue_daily", "sum", "gross_revenue"),
    "finance_net_revenue": Simple("revenue_daily", "sum", "net_revenue"),
    "finance_realized_revenue": Simple("revenue_daily", "sum", "realized_revenue"),
    "finance_cogs": Simple("revenue_daily", "sum", "total_cogs"),
    "total_discounts": Simple("revenue_daily", "sum", "total_discounts"),
    "total_refunds": Simple("revenue_daily", "sum", "total_refunds"),
    "total_completed_orders": Simple("revenue_daily", "sum", "completed_orders"),
    "total_unique_customers": Simple("revenue_daily", "sum", "unique_customers"),
    "gross_profit": Derived("{finance_net_revenue} - {finance_cogs}"),
    "gross_margin_rate": Ratio("gross_profit", "finance_net_revenue"),
    "discount_impact": Ratio("total_discounts", "finance_gross_revenue"),
    "refund_rate_pct": Ratio("total_refunds", "finance_gross_revenue"),
    "avg_customer_net_ltv": Simple("customer_ltv", "average", "net_ltv"),
    "total_refunds_finance_metric": Simple("customer_ltv", "sum", "total_refunds"),
    "total_net_ltv": Simple("customer_ltv", "sum", "net_ltv"),
    "total_customers_finance": Simple("customer_ltv", "count", "customer_id"),
    # Averages whatever months are asked for; the other one keeps to the month after acquisition.
    "cohort_month_1_retention": Simple("cohort_analysis", "average", "cast(retention_rate_pct AS decimal(12,2))"),
    "month_1_retention": Simple(
        "cohort_analysis", "average", "cast(retention_rate_pct AS decimal(12,2))", "months_since_acquisition = 1"
    ),
    "total_cohort_revenue": Simple("cohort_analysis", "sum", "cohort_net_revenue"),
    "active_cohort_customers": Simple("cohort_analysis", "sum", "active_customers"),
    "total_marketing_spend": Simple("campaign_performance", "sum", "spend_usd"),
    "total_impressions": Simple("campaign_performance", "sum", "impressions"),
    "total_clicks": Simple("campaign_performance", "sum", "clicks"),
    "total_attributed_revenue": Simple("campaign_performance", "sum", "attributed_net_revenue"),
    "total_attributed_orders": Simple("campaign_performance", "sum", "matched_orders"),
    "avg_roas": Simple("campaign_performance", "average", "cast(roas AS decimal(18,2))"),
    "blended_roas": Ratio("total_attributed_revenue", "total_marketing_spend"),
    "cost_per_order": Ratio("total_marketing_spend", "total_attributed_orders"),
    "total_channel_revenue": Simple("channel_attribution", "sum", "attributed_net_revenue"),
    "channel_order_count": Simple("channel_attribution", "sum", "attributed_orders"),
    "mobile_revenue": Simple("channel_attribution", "sum", "mobile_revenue"),
    "paid_social_revenue": Simple(
        "channel_attribution", "sum", "attributed_net_revenue", "attributed_channel = 'paid_social'"
    ),
    "paid_social_revenue_share": Derived(
        "double({paid_social_revenue}) / nullif(double({total_channel_revenue}), 0D)"
    ),
}

CATALOGUE = Metrics(FACTS, METRICS)

SAVED = {
    "revenue_by_channel_monthly": dict(
        names=["total_gross_revenue", "total_net_revenue", "average_order_value", "return_rate"],
        group_by=["store_channel"],
        grain="month",
    ),
    "revenue_by_region_monthly": dict(
        names=["total_net_revenue", "order_count", "average_order_value"], group_by=["store_region"], grain="month"
    ),
    "customer_segment_performance": dict(
        names=["total_gross_revenue", "total_net_revenue", "average_order_value"],
        group_by=["customers.customer_segment"],
        grain="month",
    ),
    "weekly_revenue_trend": dict(
        names=["total_gross_revenue", "total_net_revenue", "order_count", "return_rate"], grain="week"
    ),
    "monthly_p_and_l": dict(
        names=[
            "finance_gross_revenue",
            "finance_net_revenue",
            "finance_cogs",
            "gross_profit",
            "gross_margin_rate",
            "refund_rate_pct",
            "discount_impact",
        ],
        group_by=["store_channel"],
        grain="month",
    ),
    "channel_revenue_ytd": dict(
        names=["finance_net_revenue", "finance_realized_revenue", "total_completed_orders"],
        group_by=["store_channel", "order_year"],
    ),
    "cohort_retention_6month": dict(
        names=["cohort_month_1_retention", "total_cohort_revenue"],
        group_by=["acquisition_channel", "months_since_acquisition"],
        grain="month",
        where="months_since_acquisition <= 6",
    ),
    "customer_ltv_by_segment": dict(
        names=["avg_customer_net_ltv", "total_net_ltv", "total_customers_finance"],
        group_by=["customer_segment", "customer_value_tier"],
    ),
}


class FactTables(dict):
    """Tables for a metric request, planned when first used."""

    def __init__(self, inputs: Inputs, as_of: dt.date, cohorts_since: dt.date = dt.date(2025, 1, 1)):
        super().__init__()
        self._makers: dict[str, Callable[[], DataFrame]] = {
            model.__name__: (lambda model=model: use(inputs, model, as_of))
            for model in (
                fct_orders,
                dim_customers,
                dim_stores,
                revenue_daily,
                customer_ltv,
                campaign_performance,
                channel_attribution,
            )
        }
        self._makers["cohort_analysis"] = lambda: cohort_analysis(inputs, as_of, cohorts_since)
        self._makers["dim_dates"] = lambda: calendar(days_covering(self["fct_orders"], "order_date"))

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._makers[name]()
        return self[name]


def saved_query(name: str, tables: FactTables, where: str | None = None) -> DataFrame:
    """A saved metric query; ``where`` replaces its own filter (start month, year)."""
    request = dict(SAVED[name])
    if where:
        request["where"] = where
    return CATALOGUE.query(tables, **request)


# Measures of the three star views. Some names mean something else than the metric above.
_ACTIVE = "customer_lifecycle_stage = 'active'"
REVENUE_VIEW = {
    "total_gross_revenue": "sum(gross_revenue)",
    "total_net_revenue": "sum(net_revenue)",
    "total_realized_revenue": "sum(realized_revenue)",
    "total_orders": "count(order_id)",
    "completed_orders": "count_if(is_completed)",
    "average_order_value": mean_of("CASE WHEN is_completed THEN gross_revenue END"),
    "total_discounts": "sum(order_level_discount)",
    "total_refunds": "sum(CASE WHEN is_returned THEN refund_amount ELSE 0 END)",
    "return_rate": ratio("count_if(is_returned)", "count(order_id)", 100),
}
CUSTOMER_VIEW = {
    "total_customers": "count(customer_id)",
    "active_customers": f"count_if({_ACTIVE})",
    "at_risk_customers": "count_if(customer_lifecycle_stage = 'at_risk')",
    "churned_customers": "count_if(customer_lifecycle_stage = 'churned')",
    "avg_lifetime_revenue": mean_of("lifetime_net_revenue"),
    "total_lifetime_revenue": "sum(lifetime_net_revenue)",
    "avg_orders_per_customer": mean_of("total_orders"),
    "active_rate": ratio(f"count_if({_ACTIVE})", "count(customer_id)", 100),
}
CUSTOMER_ORDERS_VIEW = {"customer_order_count": "count(order_id)", "customer_revenue": "sum(net_revenue)"}
CAMPAIGN_VIEW = {
    "total_spend": "sum(spend_usd)",
    "total_impressions": "sum(impressions)",
    "total_clicks": "sum(clicks)",
    "total_attributed_revenue": "sum(attributed_net_revenue)",
    "total_attributed_orders": "sum(matched_orders)",
    "blended_roas": ratio("sum(attributed_net_revenue)", "sum(spend_usd)"),
    "avg_ctr": mean_of("cast(click_through_rate_pct AS decimal(18,4))"),
    "avg_cpa": mean_of("cast(cost_per_acquisition AS decimal(18,2))"),
    "high_performing_days": "count_if(roas_tier = 'high_performing')",
}
ATTRIBUTION_VIEW = {
    "channel_revenue": "sum(attributed_net_revenue)",
    "channel_orders": "sum(attributed_orders)",
    "mobile_share": mean_of("cast(mobile_revenue_pct AS decimal(18,2))"),
}


def _measures(fact: str, measures: dict[str, str]) -> Metrics:
    return Metrics(FACTS, {name: Simple(fact, sql) for name, sql in measures.items()})


VIEWS = {
    "revenue": _measures("fct_orders", REVENUE_VIEW),
    "customers": _measures("dim_customers", CUSTOMER_VIEW),
    "customer_orders": _measures("fct_orders", CUSTOMER_ORDERS_VIEW),
    "campaigns": _measures("campaign_performance", CAMPAIGN_VIEW),
    "attribution": _measures("channel_attribution", ATTRIBUTION_VIEW),
}


def view_query(
    view: str, tables: FactTables, group_by: list[str], names: list[str] | None = None, where: str | None = None
) -> DataFrame:
    metrics = VIEWS[view]
    return metrics.query(tables, names or list(metrics.metrics), group_by, where=where)
