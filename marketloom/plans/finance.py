"""Finance tables: revenue, refunds, customer value, cohorts, fiscal calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import exprs, mean_of, month_count, month_start, ratio, sum_where, zero_if_null
from marketloom.operators.numbering import global_row_number, join_null_safe
from marketloom.operators.sketches import combined_counts, distinct_counts
from marketloom.plans.base import Inputs, built_at, day, replaced, use
from marketloom.plans.core import (
    dim_customers,
    dim_dates,
    fct_orders,
    fiscal_quarter,
    fiscal_year,
)
from marketloom.plans.enrich import order_items_enriched
from marketloom.session import written

STORE_DAY = ["order_date", "order_month", "order_quarter", "order_year", "store_id", "store_channel", "store_region"]
REFUND_COLUMNS = [
    "order_id", "customer_id", "store_id", "store_channel", "store_region", "campaign_id", "order_date", "return_date",
    "return_reason", "refund_amount", "gross_revenue", "net_revenue",
]
RETURNED = "is_returned AND return_date IS NOT NULL AND refund_amount IS NOT NULL"


def _by_store_day(orders: DataFrame, *further: str) -> DataFrame:
    """Orders summed per store and day. The distinct count makes Spark group by (store, day,
    customer) first, so one busy store-day never meets in one task."""
    return orders.groupBy(*STORE_DAY).agg(
        *exprs(
            "count(*) AS total_orders",
            "count_if(is_completed) AS completed_orders",
            "count_if(is_returned) AS returned_orders",
            "count_if(is_cancelled) AS cancelled_orders",
            f"{sum_where('is_completed', 'gross_revenue')} AS gross_revenue",
            f"{sum_where('is_completed', 'net_revenue')} AS net_revenue",
            f"{sum_where('is_completed', 'realized_revenue')} AS realized_revenue",
            f"{sum_where('is_completed', 'estimated_tax')} AS estimated_tax",
            f"{sum_where('is_completed', 'order_level_discount')} AS total_discounts",
            f"{sum_where('is_returned AND refund_amount IS NOT NULL', 'refund_amount')} AS total_refunds",
            "count(DISTINCT customer_id) AS unique_customers",
            f"{mean_of('CASE WHEN is_completed THEN gross_revenue END')} AS avg_order_value",
            *further,
        )
    )


def revenue_by_period(inputs: Inputs, as_of: dt.date) -> DataFrame:
    return _by_store_day(use(inputs, fct_orders, as_of))


def revenue_daily(inputs: Inputs, as_of: dt.date, compat: bool = False) -> DataFrame:
    """Revenue per store and day with cost of goods and margin.

    The cost is summed per order and joined to the orders once, instead of joining every line
    to its order. Margin is ``(net - cost) / net``; ``compat`` keeps the unparenthesised form
    ``net - cost / net * 100``.
    """
    lines = inputs.get("fct_order_items")
    if lines is None:
        lines = use(inputs, order_items_enriched, as_of)
    cost = lines.groupBy("order_id").agg(F.expr("sum(cost_price * quantity) AS order_cost"))
    orders = use(inputs, fct_orders, as_of).join(cost, "order_id", "left")
    daily = _by_store_day(orders, f"coalesce({sum_where('is_completed', 'order_cost')}, 0) AS total_cogs")
    if compat:
        margin = f"round(double(net_revenue) - {ratio('total_cogs', 'net_revenue', 100)}, 2)"
    else:
        margin = ratio("(net_revenue - total_cogs)", "net_revenue", 100, 2)
    return daily.withColumnRenamed("order_date", "revenue_date").selectExpr(
        "revenue_date",
        "store_id",
        "store_channel",
        "store_region",
        "order_month",
        "order_quarter",
        "order_year",
        "total_orders",
        "completed_orders",
        "returned_orders",
        "cancelled_orders",
        "gross_revenue",
        "net_revenue",
        "realized_revenue",
        "estimated_tax",
        "total_discounts",
        "total_refunds",
        "unique_customers",
        "avg_order_value",
        "total_cogs",
        f"{margin} AS gross_margin_pct",
        built_at(as_of),
    )


def revenue_monthly(inputs: Inputs, as_of: dt.date, compat: bool = False) -> DataFrame:
    """Revenue per month, channel and region, with the previous month of the same series.

    ``sum_daily_unique_customers`` and ``avg_daily_aov`` are not additive and named as what
    they are; ``unique_customers`` and ``average_order_value`` are the true monthly values.
    ``compat`` takes the previous row of the channel, whatever its region.

    Orders serve the daily sums and the monthly customers; unless stored, they are built and written once.
    """
    if inputs.get("fct_orders") is None:
        inputs = replaced(inputs, fct_orders=written(fct_orders(inputs, as_of), "orders"))
    additive = [
        "total_orders", "completed_orders", "returned_orders", "gross_revenue", "net_revenue", "realized_revenue",
        "total_discounts", "total_refunds", "total_cogs", "estimated_tax",
    ]
    net, series = "sum(net_revenue)", ["order_month", "store_channel", "store_region"]
    monthly = (
        use(inputs, revenue_daily, as_of)
        .groupBy("order_month", "order_quarter", "order_year", "store_channel", "store_region")
        .agg(
            *exprs(
                *[f"sum({c}) AS {c}" for c in additive],
                "sum(unique_customers) AS sum_daily_unique_customers",
                f"{mean_of('cast(avg_order_value AS decimal(18,6))')} AS avg_daily_aov",
                f"{ratio(f'({net} - sum(total_cogs))', net, 100, 2)} AS gross_margin_pct",
                f"{ratio('sum(gross_revenue)', 'sum(completed_orders)')} AS average_order_value",
            )
        )
    )
    customers = (
        use(inputs, fct_orders, as_of).groupBy(*series).agg(F.expr("count(DISTINCT customer_id) AS unique_customers"))
    )
    joined = join_null_safe(monthly, customers, series)
    # One row per month and series: the window holds as many rows as there are months.
    if compat:
        earlier = Window.partitionBy("store_channel").orderBy("order_month", "store_region")
    else:
        earlier = Window.partitionBy("store_channel", "store_region").orderBy("order_month")
    prior = "prior_month_net_revenue"
    growth = ratio(f"(net_revenue - coalesce({prior}, net_revenue))", prior, 100, 2)
    return (
        joined.withColumn(prior, F.lag("net_revenue").over(earlier))
        .withColumnRenamed("order_month", "revenue_month")
        .selectExpr("*", f"{growth} AS mom_revenue_growth_pct", built_at(as_of))
    )


def refunds_enriched(inputs: Inputs, as_of: dt.date) -> DataFrame:
    # Numbering looks at the rows three times (bounds, sizes, numbers), so they are built once.
    back = written(use(inputs, fct_orders, as_of).filter(RETURNED).select(*REFUND_COLUMNS), "refunds")
    return global_row_number(back, "order_id", "return_id").selectExpr(
        "return_id",
        "order_id",
        "customer_id",
        "store_id",
        "store_channel",
        "store_region",
        "campaign_id",
        "order_date",
        "return_date",
        "datediff(return_date, order_date) AS days_to_return",
        "return_reason",
        f"{zero_if_null('refund_amount')} AS refund_amount",
        "gross_revenue AS original_order_gross_revenue",
        "net_revenue AS original_order_net_revenue",
        f"{ratio('refund_amount', 'gross_revenue', 100, 2)} AS refund_as_pct_of_order",
        f"{month_start('return_date')} AS return_month",
        "quarter(return_date) AS return_quarter",
        "year(return_date) AS return_year",
    )


def customer_ltv(inputs: Inputs, as_of: dt.date) -> DataFrame:
    # The refund rows are only summed here, so their running number is not computed.
    refunds = (
        use(inputs, fct_orders, as_of).filter(RETURNED).groupBy("customer_id").agg(F.expr("sum(refund_amount) AS refunds"))
    )
    refunded = zero_if_null("refunds")
    yearly = f"round(avg_order_value * ({ratio('total_orders', 'days_since_acquisition')} * 365), 2)"
    return (
        use(inputs, dim_customers, as_of)
        .join(refunds, "customer_id", "left")
        .selectExpr(
            "customer_id",
            "full_name",
            "customer_segment",
            "customer_value_tier",
            "acquisition_channel",
            "acquisition_date",
            "acquisition_month",
            "first_order_date",
            "last_order_date",
            "total_orders",
            "completed_orders",
            "lifetime_gross_revenue",
            "lifetime_net_revenue",
            f"{refunded} AS total_refunds",
            f"lifetime_net_revenue - {refunded} AS net_ltv",
            "avg_order_value",
            "customer_lifecycle_stage",
            "days_since_acquisition",
            f"CASE WHEN days_since_acquisition > 0 AND total_orders > 0 THEN {yearly} ELSE 0D END AS predicted_12m_ltv",
            built_at(as_of),
        )
    )


def customer_cohorts(inputs: Inputs, as_of: dt.date, since: dt.date = dt.date(2025, 1, 1)) -> DataFrame:
    customers = (
        use(inputs, dim_customers, as_of)
        .filter(f"acquisition_date >= {day(since)}")
        .select("customer_id", "acquisition_month", "acquisition_channel", "customer_segment")
    )
    active = (
        use(inputs, fct_orders, as_of)
        .filter("is_completed")
        .groupBy("customer_id", "order_month")
        .agg(*exprs("sum(net_revenue) AS monthly_net_revenue", "count(*) AS monthly_orders"))
    )
    return customers.join(active, "customer_id", "left").selectExpr(
        "customer_id",
        "acquisition_month AS cohort_month",
        "acquisition_channel",
        "customer_segment",
        "order_month AS activity_month",
        f"{month_count('acquisition_month', 'order_month')} AS months_since_acquisition",
        "monthly_net_revenue",
        "monthly_orders",
    )


def cohort_analysis(inputs: Inputs, as_of: dt.date, since: dt.date = dt.date(2025, 1, 1)) -> DataFrame:
    stored = inputs.get("customer_cohorts")
    cohorts = customer_cohorts(inputs, as_of, since) if stored is None else stored
    group = ["cohort_month", "acquisition_channel", "customer_segment"]
    sizes = cohorts.select(*group, "customer_id").groupBy(*group).agg(F.expr("count(DISTINCT customer_id) AS cohort_size"))
    revenue = (
        cohorts.filter("activity_month IS NOT NULL")
        .groupBy(*group, "activity_month", "months_since_acquisition")
        .agg(
            *exprs(
                # A customer has one row per month.
                "count(customer_id) AS active_customers",
                "sum(monthly_net_revenue) AS cohort_net_revenue",
                f"{mean_of('monthly_net_revenue')} AS avg_customer_revenue",
            )
        )
    )
    # One row per cohort and month: bounded by the number of months.
    to_date = Window.partitionBy(*group).orderBy("months_since_acquisition")
    to_date = to_date.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        revenue.join(sizes, group)
        .withColumn("cumulative_cohort_revenue", F.sum("cohort_net_revenue").over(to_date))
        .selectExpr(
            "cohort_month",
            "activity_month",
            "months_since_acquisition",
            "acquisition_channel",
            "customer_segment",
            "cohort_size",
            "active_customers",
            "cohort_net_revenue",
            "avg_customer_revenue",
            f"{ratio('active_customers', 'cohort_size', 100, 2)} AS retention_rate_pct",
            "cumulative_cohort_revenue",
            built_at(as_of),
        )
    )


def fiscal_calendar(days: DataFrame, as_of: dt.date, compat: bool = False) -> DataFrame:
    """Fiscal labels for a calendar table; the period starts with its month.

    ``compat`` keeps the older period start: 1 February for February to December, and
    1 November of the same year for January.
    """
    start, today, d = month_start("date_day"), day(as_of), "date_day"
    if compat:
        start = f"CASE WHEN month({d}) >= 2 THEN add_months({start}, 2 - month({d})) ELSE add_months({start}, 10) END"
    this_year = f"fiscal_year = {fiscal_year(today)}"
    return days.selectExpr(
        d,
        "fiscal_year",
        "fiscal_quarter",
        "fiscal_month",
        "'FY' || fiscal_year AS fiscal_year_label",
        "'FY' || fiscal_year || '-Q' || fiscal_quarter AS fiscal_quarter_label",
        "'FY' || fiscal_year || '-P' || lpad(string(fiscal_month), 2, '0') AS fiscal_period_label",
        f"{this_year} AS is_current_fiscal_year",
        f"{this_year} AND fiscal_quarter = {fiscal_quarter(today)} AS is_current_fiscal_quarter",
        f"{start} AS fiscal_period_start",
        "make_date(fiscal_year, 2, 1) AS fiscal_year_start",
        f"month({d}) AS calendar_month",
        f"quarter({d}) AS calendar_quarter",
        f"year({d}) AS calendar_year",
        "is_weekend",
        "is_weekday",
        "season",
    )


def dim_fiscal_calendar(spark: SparkSession, as_of: dt.date, first_year: int = 2025, last_year: int = 2027) -> DataFrame:
    days = dim_dates(spark, dt.date(first_year, 1, 1), dt.date(last_year, 12, 31))
    return fiscal_calendar(days, as_of)


def customer_sketches(inputs: Inputs, as_of: dt.date) -> DataFrame:
    """Beside ``revenue_daily``: a sketch of the customers of every store and day."""
    orders = use(inputs, fct_orders, as_of)
    return distinct_counts(orders, ["store_id", "store_region", "order_date"], "customer_id")


def unique_customers(inputs: Inputs, as_of: dt.date, period: str = "month") -> DataFrame:
    """Estimated distinct customers per region and period, from the sketches of store days; the orders are not read again."""
    days = use(inputs, customer_sketches, as_of).withColumn("period_start", F.expr(f"date(trunc(order_date, '{period}'))"))
    return combined_counts(days, ["store_region", "period_start"], "estimated_customers")
