"""Named queries over the given tables: Spark plan and, where SQL can say it, the oracle text."""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketloom import oracle
from marketloom.functions.scalars import EARTH_RADIUS_MILES, KM_PER_MILE, MONEY, NULL_KEY_TOKEN, safe_add, safe_divide, safe_subtract, url_path
from marketloom.operators import checks, diff, history, shape, sketches, spatial
from marketloom.operators.numbering import join_null_safe
from marketloom.operators.upsert import KeyedTable, merged
from marketloom.plans import core, declared, enrich, finance, increments, marketing, staging
from marketloom.plans.base import replaced
from marketloom.plans.catalogue import CATALOGUE, FactTables, saved_query, view_query
from marketloom.plans.web import url_report
from marketloom.session import configure, fresh_path, written
from marketloom.sources import sample_retail
from marketloom.sources.schemas import ALL
from marketloom.sources.tables import PublishedTable, bucketed, land, named_view, read_table
from marketloom.streaming import attribution, flows

AS_OF = dt.date(2001, 8, 2)
FIRST = dt.date(1995, 1, 1)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Run stamps are constants of a run, not results.
_STAMPS = {"built_at", "_loaded_at"}


def edge(df: DataFrame) -> DataFrame:
    """Plain types for comparing with another engine: money as double, dates as text."""
    kinds = {
        T.DecimalType: "double",
        T.FloatType: "double",
        T.DateType: "string",
        T.TimestampType: "string",
        T.TimestampNTZType: "string",
        T.IntegerType: "bigint",
        T.ShortType: "bigint",
    }
    out = []
    for field in df.schema.fields:
        kind = kinds.get(type(field.dataType))
        if field.name not in _STAMPS:
            out.append(f"{kind}(`{field.name}`) AS `{field.name}`" if kind else f"`{field.name}`")
    return df.selectExpr(*out)


def register(name: str, plan: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name!r} registered twice")
    QUERIES[name] = lambda spark, folder: edge(plan(configure(spark), folder))
    if sql is not None:
        ORACLES[name] = sql


def retail(model: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: model(sample_retail.retail_inputs(spark, folder), AS_OF, *args, **kwargs)


def web(model: Callable[..., DataFrame]) -> Query:
    return lambda spark, folder: model(sample_retail.web_inputs(spark, folder), AS_OF)


def _orders_calendar(spark: SparkSession, folder: str) -> DataFrame:
    orders = sample_retail.retail_inputs(spark, folder)["raw_orders"]
    return core.calendar(core.days_covering(orders, "order_date"))


def _register_pipelines() -> None:
    table = oracle.table
    register(
        "stg_customers",
        lambda s, d: retail(staging.stg_customers)(s, d).drop("created_at", "updated_at"),
        table(
            "stg_customers",
            text="first_name last_name full_name email city state customer_segment acquisition_channel gender",
            whole="customer_id age acquisition_year days_since_acquisition",
            day="acquisition_date acquisition_month acquisition_quarter",
            flag="is_email_subscribed is_sms_subscribed",
        ),
    )
    register(
        "stg_orders",
        lambda s, d: retail(staging.stg_orders)(s, d).drop("ordered_at"),
        table(
            "stg_orders",
            text="order_status payment_method traffic_source",
            whole="order_id customer_id store_id campaign_id item_count order_day_of_week order_month_num order_quarter order_year",
            number="discount_amount",
            day="order_date order_month order_week",
            flag="is_completed is_returned is_cancelled has_discount",
        ),
    )
    register(
        "stg_order_items",
        retail(staging.stg_order_items),
        table(
            "stg_order_items",
            whole="order_item_id order_id product_id quantity",
            number="unit_price_at_purchase line_gross_revenue line_net_revenue line_discount line_discount_amount discount_pct",
        ),
    )
    register(
        "stg_returns",
        retail(staging.stg_returns),
        table(
            "stg_returns",
            text="return_reason resolution_type return_status",
            whole="return_id order_id customer_id store_id days_to_return",
            number="refund_amount",
            day="order_date return_date",
            flag="is_approved",
        ),
    )
    spend = dict(
        text="campaign_name channel campaign_type",
        whole="spend_id campaign_id impressions clicks attributed_orders spend_quarter spend_year",
        number="spend_usd click_through_rate_pct cost_per_click cost_per_acquisition",
        day="spend_date spend_week spend_month",
    )
    register("stg_ad_spend", retail(staging.stg_ad_spend), table("stg_ad_spend", **spend))
    register(
        "stg_platform_ad_spend",
        retail(staging.stg_platform_ad_spend),
        oracle.query(
            "SELECT "
            + oracle.columns(**{**spend, "number": "spend_usd cost_per_acquisition"})
            + f", coalesce({oracle.half_up('clicks', 'impressions', 4, 100)}, 0)::DOUBLE AS click_through_rate_pct"
            + f", {oracle.half_up('spend_usd', 'clicks', 4)}::DOUBLE AS cost_per_click FROM stg_ad_spend"
        ),
    )
    register(
        "stg_campaigns",
        retail(staging.stg_campaigns),
        oracle.query("""
        SELECT DISTINCT campaign_id::BIGINT AS campaign_id, campaign_name, channel, campaign_type,
               min(spend_date) OVER w::VARCHAR AS start_date, max(spend_date) OVER w::VARCHAR AS end_date,
               (sum(spend_usd) OVER w)::DOUBLE AS budget_usd,
               date_trunc('month', min(spend_date) OVER w)::DATE::VARCHAR AS campaign_start_month,
               quarter(min(spend_date) OVER w)::BIGINT AS campaign_quarter, year(min(spend_date) OVER w)::BIGINT AS campaign_year
        FROM raw_ad_spend WINDOW w AS (PARTITION BY campaign_id)""".replace(
            "min(spend_date) OVER w::VARCHAR", "(min(spend_date) OVER w)::VARCHAR"
        ).replace("max(spend_date) OVER w::VARCHAR", "(max(spend_date) OVER w)::VARCHAR")),
    )
    register(
        "stg_platform_campaigns",
        retail(staging.stg_platform_campaigns),
        """
        WITH c AS (SELECT *, DATE '1995-01-01' + (s_suppkey % 700)::INT AS start_date, (s_suppkey % 60 + 2)::BIGINT AS days FROM supplier)
        SELECT s_suppkey AS campaign_id, 'Campaign ' || s_suppkey AS campaign_name,
               ['paid_search', 'paid_social', 'email', 'affiliate'][s_suppkey % 4 + 1] AS channel,
               ['awareness', 'conversion', 'retention'][s_suppkey % 3 + 1] AS campaign_type,
               start_date::VARCHAR AS start_date, (start_date + (days - 1)::INT)::VARCHAR AS end_date,
               abs(floor(s_acctbal))::BIGINT AS budget_usd, 'BUILDING' AS target_segment,
               ['paid_search', 'paid_social', 'email', 'affiliate'][s_suppkey % 4 + 1] AS utm_source, 'cpc' AS utm_medium,
               'c' || s_suppkey AS utm_campaign, s_suppkey % 5 <> 0 AS is_active, days AS campaign_duration_days,
               """
        + oracle.half_up("abs(floor(s_acctbal))", "days", 2)
        + """ AS daily_budget_usd,
               date_trunc('month', start_date)::DATE::VARCHAR AS campaign_start_month,
               quarter(start_date)::BIGINT AS campaign_quarter, year(start_date)::BIGINT AS campaign_year FROM c""",
    )
    order_columns = dict(
        text="store_name store_type store_channel store_city store_state store_region order_status payment_method traffic_source return_reason",
        whole="order_id customer_id store_id campaign_id item_count order_quarter order_year total_units distinct_products",
        number="gross_revenue net_revenue estimated_tax refund_amount discount_amount",
        day="order_date order_month order_week return_date",
        flag="is_completed is_returned is_cancelled has_discount has_return",
    )

    def renamed(kinds: dict[str, str], source: str) -> str:
        return oracle.table(source, **kinds).replace("CAST(discount_amount AS DOUBLE) AS discount_amount", "CAST(discount_amount AS DOUBLE) AS order_level_discount")

    register("orders_enriched", lambda s, d: retail(enrich.orders_enriched)(s, d).drop("ordered_at"), renamed(order_columns, "orders_enriched"))
    with_realized = {**order_columns, "number": order_columns["number"] + " realized_revenue"}
    register("fct_orders", lambda s, d: retail(core.fct_orders)(s, d).drop("ordered_at"), renamed(with_realized, "fct_orders"))
    line_columns = dict(
        text="product_name sku category subcategory brand",
        whole="order_item_id order_id product_id quantity",
        number="unit_price_at_purchase cost_price line_gross_revenue line_net_revenue line_discount discount_pct unit_margin line_margin line_margin_pct",
        flag="is_featured",
    )
    register("order_items_enriched", retail(enrich.order_items_enriched), table("order_items_enriched", **line_columns))
    register(
        "fct_order_items",
        retail(core.fct_order_items),
        table(
            "fct_order_items",
            **{
                **line_columns,
                "text": line_columns["text"] + " store_channel traffic_source order_status",
                "whole": line_columns["whole"] + " customer_id store_id campaign_id order_year",
            },
            day="order_date order_month",
        ),
    )
    customer_columns = dict(
        text="first_name last_name full_name email city state customer_segment acquisition_channel gender most_common_channel"
        " customer_lifecycle_stage customer_value_tier",
        whole="customer_id age acquisition_year days_since_acquisition total_orders completed_orders returned_orders cancelled_orders"
        " days_between_first_last_order distinct_channels_used",
        number="lifetime_gross_revenue lifetime_net_revenue avg_order_value",
        day="acquisition_date acquisition_month acquisition_quarter first_order_date last_order_date",
        flag="is_email_subscribed is_sms_subscribed",
    )
    register("dim_customers", retail(core.dim_customers), table("dim_customers", **customer_columns))
    register(
        "dim_products",
        retail(core.dim_products),
        table(
            "products",
            text="product_name sku category subcategory brand",
            whole="product_id",
            number="unit_price cost_price margin_pct weight_lbs",
            day="launch_date",
            flag="is_active is_featured",
        ),
    )
    register(
        "dim_stores",
        retail(core.dim_stores),
        oracle.query(
            "SELECT " + oracle.columns(text="store_name store_type channel city state region", whole="store_id", flag="is_active")
            + ", CAST(DATE '1990-01-01' + (store_id * 30)::INT AS VARCHAR) AS opened_date, store_id * 1000 + 500 AS sq_footage,"
            " 'District ' || (store_id % 4) AS district, 'Manager ' || store_id AS manager_name FROM stores"
        ),
    )
    register(
        "dim_promotions",
        lambda s, d: retail(core.dim_promotions)(s, d).drop("built_at"),
        """SELECT p_partkey AS promotion_id, 'SAVE' || p_partkey AS promotion_code, p_brand || ' week' AS promotion_name,
                  CASE WHEN p_size % 2 = 0 THEN 'percentage' ELSE 'fixed_amount' END AS discount_type, (p_size * 2.5)::DOUBLE AS discount_value,
                  floor(p_retailprice)::DOUBLE AS min_order_amount, (DATE '1996-01-01' + (p_partkey % 900)::INT)::VARCHAR AS start_date,
                  (DATE '1996-01-01' + (p_partkey % 900)::INT + p_size::INT + 6)::VARCHAR AS end_date,
                  (['in-store', 'online', 'mobile'])[(p_partkey % 3 + 1)::INT] AS channel, p_partkey % 4 = 0 AS is_stackable,
                  (p_size * 1000)::BIGINT AS max_redemptions, p_partkey % 6 <> 0 AS is_active FROM part WHERE p_size < 10""",
    )
    register(
        "dim_payment_methods",
        lambda s, d: retail(core.dim_payment_methods)(s, d).drop("built_at"),
        """SELECT min(o_orderkey) AS payment_method_id, lower(o_orderpriority || '-' || o_orderstatus) AS payment_method,
                  CASE WHEN o_orderstatus = 'F' THEN 'card' ELSE 'wallet' END AS payment_category, 'processor ' || o_orderstatus AS processor,
                  (min(o_orderkey) % 5 + 0.5)::DOUBLE AS processing_fee_pct, o_orderstatus <> 'P' AS supports_refund,
                  o_orderstatus = 'F' AS supports_partial_refund, min(o_orderkey) % 9 <> 0 AS is_active
           FROM orders GROUP BY o_orderpriority, o_orderstatus""",
    )
    register(
        "dim_dates",
        _orders_calendar,
        table(
            "calendar",
            text="day_of_week_name month_name quarter_name season",
            whole="day_of_week_num day_of_month day_of_year week_of_year month_num quarter_num year_num fiscal_year fiscal_quarter fiscal_month",
            day="date_day week_start_date month_start_date quarter_start_date",
            flag="is_weekend is_weekday is_black_friday is_cyber_monday is_christmas is_new_years is_independence_day is_valentines_day",
        ),
    )
    register(
        "dim_fiscal_calendar",
        lambda s, d: finance.fiscal_calendar(_orders_calendar(s, d), AS_OF),
        table(
            "fiscal",
            text="fiscal_year_label fiscal_quarter_label fiscal_period_label season",
            whole="fiscal_year fiscal_quarter fiscal_month calendar_month calendar_quarter calendar_year",
            day="date_day fiscal_period_start fiscal_year_start",
            flag="is_current_fiscal_year is_current_fiscal_quarter is_weekend is_weekday",
        ),
    )
    register(
        "time_spine",
        lambda s, d: _orders_calendar(s, d).select("date_day"),
        oracle.query("SELECT date_day::VARCHAR AS date_day FROM calendar"),
    )
    register(
        "store_performance",
        retail(core.store_performance, first=FIRST),
        table(
            "store_performance",
            text="store_name channel region top_category performance_tier",
            whole="store_id total_orders completed_orders returned_orders unique_customers",
            number="gross_revenue net_revenue realized_revenue refund_amount average_order_value return_rate_pct",
            day="order_date",
        ),
    )
    daily = dict(
        text="store_channel store_region",
        whole="store_id order_quarter order_year total_orders completed_orders returned_orders cancelled_orders unique_customers",
        number="gross_revenue net_revenue realized_revenue estimated_tax total_discounts total_refunds avg_order_value total_cogs gross_margin_pct",
        day="revenue_date order_month",
    )
    register("revenue_daily", retail(finance.revenue_daily), table("revenue_daily", **daily))
    register(
        "revenue_monthly",
        retail(finance.revenue_monthly),
        oracle.query(
            "SELECT "
            + oracle.columns(
                text="store_channel store_region",
                whole="order_quarter order_year total_orders completed_orders returned_orders sum_daily_unique_customers unique_customers",
                number="gross_revenue net_revenue realized_revenue total_discounts total_refunds total_cogs estimated_tax"
                " gross_margin_pct average_order_value prior_month_net_revenue mom_revenue_growth_pct avg_daily_aov",
                day="revenue_month",
            )
            + " FROM revenue_monthly"
        ),
    )
    register(
        "refunds",
        retail(finance.refunds_enriched),
        table(
            "refunds",
            text="store_channel store_region return_reason",
            whole="return_id order_id customer_id store_id campaign_id days_to_return return_quarter return_year",
            number="refund_amount original_order_gross_revenue original_order_net_revenue refund_as_pct_of_order",
            day="order_date return_date return_month",
        ),
    )
    register(
        "customer_ltv",
        retail(finance.customer_ltv),
        table(
            "customer_ltv",
            text="full_name customer_segment customer_value_tier acquisition_channel customer_lifecycle_stage",
            whole="customer_id total_orders completed_orders days_since_acquisition",
            number="lifetime_gross_revenue lifetime_net_revenue total_refunds net_ltv avg_order_value predicted_12m_ltv",
            day="acquisition_date acquisition_month first_order_date last_order_date",
        ),
    )
    register(
        "cohorts",
        retail(finance.customer_cohorts, since=FIRST),
        table(
            "cohorts",
            text="acquisition_channel customer_segment",
            whole="customer_id months_since_acquisition monthly_orders",
            number="monthly_net_revenue",
            day="cohort_month activity_month",
        ),
    )
    register(
        "cohort_analysis",
        retail(finance.cohort_analysis, since=FIRST),
        table(
            "cohort_analysis",
            text="acquisition_channel customer_segment",
            whole="months_since_acquisition cohort_size active_customers",
            number="cohort_net_revenue avg_customer_revenue retention_rate_pct cumulative_cohort_revenue",
            day="cohort_month activity_month",
        ),
    )
    campaign = dict(
        text="campaign_name channel campaign_type",
        whole="campaign_id impressions clicks platform_attributed_orders matched_orders spend_quarter spend_year",
        number="spend_usd click_through_rate_pct cost_per_click cost_per_acquisition attributed_gross_revenue attributed_net_revenue"
        " attributed_realized_revenue attributed_aov roas",
        day="spend_date spend_week spend_month",
    )
    register("campaign_daily", retail(marketing.campaign_daily), table("campaign_performance", **campaign))
    register(
        "campaign_performance",
        retail(marketing.campaign_performance),
        table("campaign_performance", **{**campaign, "text": campaign["text"] + " roas_tier"}),
    )
    register(
        "last_touch",
        web(marketing.attribution_touchpoints),
        table(
            "touchpoints",
            text="order_traffic_source attributed_channel device_type",
            whole="order_id customer_id",
            number="gross_revenue net_revenue realized_revenue",
            day="order_date touchpoint_date",
        ),
    )
    register(
        "channel_attribution",
        web(marketing.channel_attribution),
        table(
            "channel_attribution",
            text="attributed_channel",
            whole="attributed_orders unique_customers",
            number="attributed_gross_revenue attributed_net_revenue attributed_realized_revenue attributed_aov mobile_revenue"
            " desktop_revenue tablet_revenue mobile_revenue_pct",
            day="order_month",
        ),
    )
    register(
        "approximate_common_channel",
        retail(enrich.customer_channels),
        oracle.query("""
        , c AS (SELECT customer_id, traffic_source, count(*) AS n FROM fct_orders WHERE traffic_source IS NOT NULL GROUP BY ALL)
        SELECT customer_id, arg_min(traffic_source, (-n, traffic_source)) AS most_common_channel, max(n) AS estimated,
               sum(n)::BIGINT AS seen, 0::BIGINT AS error FROM c GROUP BY 1"""),
    )

    def estimated_within(spark: SparkSession, folder: str) -> DataFrame:
        """Estimates for months, quarters and years from one set of day sketches, against the exact counts."""
        inputs = sample_retail.retail_inputs(spark, folder)
        orders = written(core.fct_orders(inputs, AS_OF).select("store_id", "store_region", "order_date", "customer_id"), "orders")
        days = written(finance.customer_sketches({"fct_orders": orders}, AS_OF), "customer-sketches")
        out = []
        for period in ("month", "quarter", "year"):
            estimate = finance.unique_customers({"customer_sketches": days}, AS_OF, period)
            exact = orders.groupBy("store_region", F.expr(f"date(trunc(order_date, '{period}')) AS period_start"))
            both = join_null_safe(exact.agg(F.countDistinct("customer_id").alias("customers")), estimate, ["store_region", "period_start"])
            near = F.abs(F.col("estimated_customers") - F.col("customers")) <= F.greatest(F.lit(2), 4 * sketches.STANDARD_ERROR * F.col("customers"))
            out.append(both.select(F.lit(period).alias("period"), "store_region", "period_start", "customers", near.alias("within_bound")))
        return out[0].unionByName(out[1]).unionByName(out[2])

    register(
        "approximate_unique_customers",
        estimated_within,
        oracle.query("""
        SELECT period, store_region, date_trunc(period, order_date)::DATE::VARCHAR AS period_start, count(DISTINCT customer_id) AS customers, true AS within_bound
        FROM fct_orders, (VALUES ('month'), ('quarter'), ('year')) AS t(period) GROUP BY 1, 2, 3"""),
    )

    def nearest_supplier(spark: SparkSession, folder: str) -> DataFrame:
        customers = sample_retail.located(sample_retail.load(spark, folder, "customer"), "c_custkey")
        suppliers = sample_retail.located(sample_retail.load(spark, folder, "supplier"), "s_suppkey")
        near = spatial.nearest_in_rings(customers, suppliers, "c_custkey", "s_suppkey", unit="km")
        return near.select(F.col("point_id").alias("c_custkey"), F.col("site_id").alias("s_suppkey"), F.round("distance", 3).alias("km"))

    place = "(({k} - CASE WHEN {k} % 17 = 0 THEN 1 ELSE 0 END) * {a} % {b} - {c}) / 1000.0::DOUBLE"
    at = lambda key: f"radians({place.format(k=key, a=7919, b=170000, c=85000)}) AS lat, radians({place.format(k=key, a=104729, b=360000, c=180000)}) AS lon"
    register(
        "nearest_supplier",
        nearest_supplier,
        f"""WITH c AS (SELECT c_custkey, {at("c_custkey")} FROM customer), s AS (SELECT s_suppkey, {at("s_suppkey")} FROM supplier),
        d AS (SELECT c_custkey, s_suppkey, 2 * {EARTH_RADIUS_MILES} * {KM_PER_MILE} * asin(sqrt(least(1, pow(sin((s.lat - c.lat) / 2), 2)
              + cos(c.lat) * cos(s.lat) * pow(sin((s.lon - c.lon) / 2), 2)))) AS km FROM c CROSS JOIN s)
        SELECT c_custkey, arg_min(s_suppkey, (round(km, 6), s_suppkey)) AS s_suppkey, round(min(km), 3) AS km FROM d GROUP BY 1""",
    )
    register(
        "customer_acquisition",
        retail(marketing.customer_acquisition),
        oracle.query("""
        SELECT acquisition_channel, acquisition_month::VARCHAR AS acquisition_month, acquisition_quarter::VARCHAR AS acquisition_quarter,
               acquisition_year::BIGINT AS acquisition_year, count(DISTINCT customer_id) AS new_customers,
               sum(lifetime_net_revenue)::DOUBLE AS cohort_ltv,
               sum(lifetime_net_revenue)::DOUBLE / count(*)::DOUBLE AS avg_cohort_ltv,
               sum(total_orders)::DOUBLE / count(*)::DOUBLE AS avg_orders_per_customer,
               count(*) FILTER (customer_value_tier = 'high_value') AS high_value_customers
        FROM dim_customers GROUP BY ALL"""),
    )



# Metrics.


def _facts(spark: SparkSession, folder: str) -> FactTables:
    return FactTables(sample_retail.retail_inputs(spark, folder), AS_OF, FIRST)


def _stored_facts(spark: SparkSession, folder: str) -> FactTables:
    """Tables that several facts are built from, written once."""
    inputs = sample_retail.retail_inputs(spark, folder)
    for model in (core.fct_orders, core.dim_customers):
        inputs[model.__name__] = written(model(inputs, AS_OF), model.__name__)
    return FactTables(inputs, AS_OF, FIRST)


def _web_facts(spark: SparkSession, folder: str) -> FactTables:
    return FactTables(sample_retail.web_inputs(spark, folder), AS_OF, FIRST)


def _metric_sql(values: str, source: str, dims: str = "", grain: str = "", time: str = "order_date", where: str = "") -> str:
    keys = [d for d in [dims, f"date_trunc('{grain}', {time})::DATE::VARCHAR AS metric_time" if grain else ""] if d]
    return oracle.query(f"SELECT {', '.join([*keys, values])} FROM {source} {where and 'WHERE ' + where} GROUP BY ALL")


_AOV = "sum(gross_revenue)::DOUBLE / nullif(count(*) FILTER (is_completed), 0) AS average_order_value"
_GROSS = "sum(gross_revenue)::DOUBLE AS total_gross_revenue"
_NET = "sum(net_revenue)::DOUBLE AS total_net_revenue"
_RETURNS = "(count(*) FILTER (is_returned))::DOUBLE / count(*) AS return_rate"


def _register_metrics() -> None:
    def saved(name: str, sql: str, where: str | None = None) -> None:
        register(name, lambda s, d: saved_query(name, _facts(s, d), where), sql)

    saved(
        "revenue_by_channel_monthly",
        _metric_sql(f"{_GROSS}, {_NET}, {_AOV}, {_RETURNS}", "fct_orders", "store_channel", "month", where="order_date >= DATE '1996-06-01'"),
        "order_date >= DATE'1996-06-01'",
    )
    saved("revenue_by_region_monthly", _metric_sql(f"{_NET}, count(*) AS order_count, {_AOV}", "fct_orders", "store_region", "month"))
    saved(
        "customer_segment_performance",
        _metric_sql(
            f"{_GROSS}, {_NET}, {_AOV}", "fct_orders LEFT JOIN dim_customers USING (customer_id)", "customer_segment", "month"
        ),
    )
    saved("weekly_revenue_trend", _metric_sql(f"{_GROSS}, {_NET}, count(*) AS order_count, {_RETURNS}", "fct_orders", "", "week"))
    saved(
        "monthly_p_and_l",
        _metric_sql(
            """sum(gross_revenue)::DOUBLE AS finance_gross_revenue, sum(net_revenue)::DOUBLE AS finance_net_revenue,
            sum(total_cogs)::DOUBLE AS finance_cogs, (sum(net_revenue) - sum(total_cogs))::DOUBLE AS gross_profit,
            (sum(net_revenue) - sum(total_cogs))::DOUBLE / nullif(sum(net_revenue), 0)::DOUBLE AS gross_margin_rate,
            sum(total_refunds)::DOUBLE / nullif(sum(gross_revenue), 0)::DOUBLE AS refund_rate_pct,
            sum(total_discounts)::DOUBLE / nullif(sum(gross_revenue), 0)::DOUBLE AS discount_impact""",
            "revenue_daily",
            "store_channel",
            "month",
            "revenue_date",
        ),
    )
    saved(
        "channel_revenue_ytd",
        _metric_sql(
            """sum(net_revenue)::DOUBLE AS finance_net_revenue, sum(realized_revenue)::DOUBLE AS finance_realized_revenue,
            sum(completed_orders)::BIGINT AS total_completed_orders""",
            "revenue_daily",
            "store_channel, order_year",
            where="order_year = 2000",
        ),
        "order_year = 2000",
    )
    saved(
        "cohort_retention_6month",
        _metric_sql(
            """sum(retention_rate_pct::DECIMAL(12,2))::DOUBLE / count(*) AS cohort_month_1_retention,
            sum(cohort_net_revenue)::DOUBLE AS total_cohort_revenue""",
            "cohort_analysis",
            "acquisition_channel, months_since_acquisition",
            "month",
            "cohort_month",
            "months_since_acquisition <= 6",
        ),
    )
    saved(
        "customer_ltv_by_segment",
        _metric_sql(
            """sum(net_ltv)::DOUBLE / count(*) AS avg_customer_net_ltv, sum(net_ltv)::DOUBLE AS total_net_ltv,
            count(*) AS total_customers_finance""",
            "customer_ltv",
            "customer_segment, customer_value_tier",
        ),
    )
    register(
        "metric_month_over_month",
        lambda s, d: CATALOGUE.query(
            _facts(s, d), ["total_net_revenue", "revenue_mom_growth"], ["store_channel", "store_region"], "month"
        ),
        oracle.query("""
        , m AS (SELECT store_channel, store_region, order_month, sum(net_revenue) AS net FROM fct_orders GROUP BY ALL)
        SELECT m.store_channel, m.store_region, m.order_month::VARCHAR AS metric_time, m.net::DOUBLE AS total_net_revenue,
               (m.net - p.net)::DOUBLE / nullif(p.net, 0)::DOUBLE AS revenue_mom_growth
        FROM m LEFT JOIN m p ON p.store_channel = m.store_channel AND p.store_region = m.store_region
         AND p.order_month = m.order_month - INTERVAL 1 MONTH"""),
    )
    register(
        "metric_across_facts",
        lambda s, d: (lambda t: CATALOGUE.query(
            t,
            ["total_net_revenue", "discount_rate", "total_marketing_spend", "blended_roas", "cost_per_order", "finance_cogs",
             "total_customers", "customer_retention_rate", "average_customer_ltv"],
            [],
            "month",
            spine=t["dim_dates"],
        ))(_stored_facts(s, d)),
        oracle.query("""
        SELECT p.m::VARCHAR AS metric_time, o.net::DOUBLE AS total_net_revenue, o.off::DOUBLE / nullif(o.gross, 0)::DOUBLE AS discount_rate,
               a.spend::DOUBLE AS total_marketing_spend, a.revenue::DOUBLE / nullif(a.spend, 0)::DOUBLE AS blended_roas,
               a.spend::DOUBLE / nullif(a.orders, 0)::DOUBLE AS cost_per_order, r.cogs::DOUBLE AS finance_cogs,
               c.n AS total_customers, c.active::DOUBLE / nullif(c.n, 0)::DOUBLE AS customer_retention_rate,
               c.ltv::DOUBLE / nullif(c.n, 0)::DOUBLE AS average_customer_ltv
        FROM (SELECT DISTINCT month_start_date AS m FROM calendar) p
        LEFT JOIN (SELECT order_month AS m, sum(net_revenue) AS net, sum(gross_revenue) AS gross, sum(discount_amount) AS off FROM fct_orders GROUP BY 1) o ON o.m = p.m
        LEFT JOIN (SELECT spend_month AS m, sum(spend_usd) AS spend, sum(attributed_net_revenue) AS revenue, sum(matched_orders) AS orders
                   FROM campaign_performance GROUP BY 1) a ON a.m = p.m
        LEFT JOIN (SELECT order_month AS m, sum(total_cogs) AS cogs FROM revenue_daily GROUP BY 1) r ON r.m = p.m
        LEFT JOIN (SELECT acquisition_month AS m, count(*) AS n, count(*) FILTER (customer_lifecycle_stage = 'active') AS active,
                          sum(lifetime_net_revenue) AS ltv FROM dim_customers GROUP BY 1) c ON c.m = p.m"""),
    )
    register(
        "metric_by_channel_every_month",
        lambda s, d: CATALOGUE.query(
            _facts(s, d), ["total_net_revenue", "order_count"], ["store_channel", "traffic_source"], "month",
            where="campaign_id IS NOT NULL AND is_returned", spine=core.time_spine(s, dt.date(1997, 11, 1), dt.date(2001, 12, 31)),
        ),
        oracle.query("""
        , kept AS (SELECT store_channel, traffic_source, order_month, net_revenue FROM fct_orders WHERE campaign_id IS NOT NULL AND is_returned),
        g AS (SELECT store_channel, traffic_source, order_month, sum(net_revenue) AS net, count(*) AS n FROM kept GROUP BY ALL),
        p AS (SELECT unnest(generate_series(DATE '1997-11-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS m)
        SELECT d.store_channel, d.traffic_source, p.m::VARCHAR AS metric_time, g.net::DOUBLE AS total_net_revenue, g.n AS order_count
        FROM (SELECT DISTINCT store_channel, traffic_source FROM g) d CROSS JOIN p
        LEFT JOIN g ON g.store_channel IS NOT DISTINCT FROM d.store_channel AND g.traffic_source IS NOT DISTINCT FROM d.traffic_source AND g.order_month = p.m"""),
    )
    register(
        "metric_channel_share",
        lambda s, d: CATALOGUE.query(
            _web_facts(s, d),
            ["total_channel_revenue", "channel_order_count", "mobile_revenue", "paid_social_revenue", "paid_social_revenue_share"],
            [],
            "month",
        ),
        _metric_sql(
            """sum(attributed_net_revenue)::DOUBLE AS total_channel_revenue, sum(attributed_orders)::BIGINT AS channel_order_count,
            sum(mobile_revenue)::DOUBLE AS mobile_revenue,
            (sum(attributed_net_revenue) FILTER (attributed_channel = 'paid_social'))::DOUBLE AS paid_social_revenue,
            (sum(attributed_net_revenue) FILTER (attributed_channel = 'paid_social'))::DOUBLE / sum(attributed_net_revenue)::DOUBLE
              AS paid_social_revenue_share""",
            "channel_attribution",
            "",
            "month",
            "order_month",
        ),
    )
    def metrics(name: str, names: list[str], dims: list[str], sql: str, source: str, time: str) -> None:
        register(name, lambda s, d: CATALOGUE.query(_facts(s, d), names, dims, "month"), _metric_sql(sql, source, ", ".join(dims), "month", time))

    metrics(
        "metric_order_amounts",
        ["realized_revenue", "refund_amount", "total_units_sold"],
        ["store_channel"],
        "sum(realized_revenue)::DOUBLE AS realized_revenue, sum(refund_amount)::DOUBLE AS refund_amount, sum(total_units)::BIGINT AS total_units_sold",
        "fct_orders",
        "order_date",
    )
    metrics(
        "metric_customer_value",
        ["total_customer_ltv", "avg_order_count_per_customer"],
        ["customer_segment"],
        "sum(lifetime_net_revenue)::DOUBLE AS total_customer_ltv, sum(total_orders)::DOUBLE / count(*) AS avg_order_count_per_customer",
        "dim_customers",
        "acquisition_month",
    )
    metrics(
        "metric_store_customers",
        ["total_unique_customers"],
        ["store_region"],
        "sum(unique_customers)::BIGINT AS total_unique_customers",
        "revenue_daily",
        "revenue_date",
    )
    metrics(
        "metric_customer_refunds",
        ["total_refunds_finance_metric"],
        ["customer_segment"],
        "sum(total_refunds)::DOUBLE AS total_refunds_finance_metric",
        "customer_ltv",
        "acquisition_month",
    )
    metrics(
        "metric_cohort_customers",
        ["active_cohort_customers"],
        ["acquisition_channel"],
        "sum(active_customers)::BIGINT AS active_cohort_customers",
        "cohort_analysis",
        "cohort_month",
    )
    metrics(
        "metric_campaign_reach",
        ["total_impressions", "total_clicks", "avg_roas"],
        ["channel"],
        """sum(impressions)::BIGINT AS total_impressions, sum(clicks)::BIGINT AS total_clicks,
        sum(roas::DECIMAL(18,2))::DOUBLE / count(roas) AS avg_roas""",
        "campaign_performance",
        "spend_date",
    )
    register(
        "semantic_revenue",
        lambda s, d: view_query("revenue", _facts(s, d), ["stores.district", "dates.season", "dates.fiscal_year"]),
        _metric_sql(
            f"""{_GROSS}, {_NET}, sum(realized_revenue)::DOUBLE AS total_realized_revenue, count(*) AS total_orders,
            count(*) FILTER (is_completed) AS completed_orders,
            sum(CASE WHEN is_completed THEN gross_revenue END)::DOUBLE / nullif(count(*) FILTER (is_completed), 0) AS average_order_value,
            sum(discount_amount)::DOUBLE AS total_discounts,
            sum(CASE WHEN is_returned THEN refund_amount ELSE 0 END)::DOUBLE AS total_refunds,
            (count(*) FILTER (is_returned))::DOUBLE / count(*)::DOUBLE * 100 AS return_rate""",
            "fct_orders LEFT JOIN calendar ON date_day = order_date",
            "'District ' || (store_id % 4) AS district, season, fiscal_year::BIGINT AS fiscal_year",
        ),
    )
    register(
        "semantic_customers",
        lambda s, d: view_query("customers", _facts(s, d), ["customer_segment", "acquisition_channel"]),
        _metric_sql(
            """count(*) AS total_customers, count(*) FILTER (customer_lifecycle_stage = 'active') AS active_customers,
            count(*) FILTER (customer_lifecycle_stage = 'at_risk') AS at_risk_customers,
            count(*) FILTER (customer_lifecycle_stage = 'churned') AS churned_customers,
            sum(lifetime_net_revenue)::DOUBLE / count(*) AS avg_lifetime_revenue, sum(lifetime_net_revenue)::DOUBLE AS total_lifetime_revenue,
            sum(total_orders)::DOUBLE / count(*) AS avg_orders_per_customer,
            (count(*) FILTER (customer_lifecycle_stage = 'active'))::DOUBLE / count(*)::DOUBLE * 100 AS active_rate""",
            "dim_customers",
            "customer_segment, acquisition_channel",
        ),
    )
    register(
        "semantic_customer_orders",
        lambda s, d: view_query("customer_orders", _facts(s, d), ["customers.customer_value_tier", "customers.gender", "order_year"]),
        _metric_sql(
            "count(*) AS customer_order_count, sum(net_revenue)::DOUBLE AS customer_revenue",
            "fct_orders LEFT JOIN dim_customers USING (customer_id)",
            "customer_value_tier, gender, order_year",
        ),
    )
    register(
        "semantic_campaigns",
        lambda s, d: view_query("campaigns", _facts(s, d), ["channel", "spend_year"]),
        _metric_sql(
            """sum(spend_usd)::DOUBLE AS total_spend, sum(impressions)::BIGINT AS total_impressions, sum(clicks)::BIGINT AS total_clicks,
            sum(attributed_net_revenue)::DOUBLE AS total_attributed_revenue, sum(matched_orders)::BIGINT AS total_attributed_orders,
            sum(attributed_net_revenue)::DOUBLE / nullif(sum(spend_usd), 0)::DOUBLE AS blended_roas,
            sum(click_through_rate_pct::DECIMAL(18,4))::DOUBLE / nullif(count(click_through_rate_pct), 0) AS avg_ctr,
            sum(cost_per_acquisition::DECIMAL(18,2))::DOUBLE / nullif(count(cost_per_acquisition), 0) AS avg_cpa,
            count(*) FILTER (roas_tier = 'high_performing') AS high_performing_days""",
            "campaign_performance",
            "channel, spend_year",
        ),
    )
    register(
        "semantic_attribution",
        lambda s, d: view_query("attribution", _web_facts(s, d), ["attributed_channel"]),
        _metric_sql(
            """sum(attributed_net_revenue)::DOUBLE AS channel_revenue, sum(attributed_orders)::BIGINT AS channel_orders,
            sum(mobile_revenue_pct::DECIMAL(18,2))::DOUBLE / count(*) AS mobile_share""",
            "channel_attribution",
            "attributed_channel",
        ),
    )



# Checks, on tables that break them. A check's query returns its failing rows.


def given(name: str) -> Query:
    return lambda s, d: sample_retail.load(s, d, name)


def raw(name: str) -> Query:
    return lambda s, d: sample_retail.retail_inputs(s, d)[name]


def _register_checks() -> None:
    orders, lineitem, customer = given("orders"), given("lineitem"), given("customer")
    register(
        "check_row_rules",
        lambda s, d: checks.run_row_checks(
            raw("raw_orders")(s, d),
            {
                "campaign_not_null": checks.fails_not_null("campaign_id"),
                "customer_not_null": checks.fails_not_null("customer_id"),
                "status_accepted": checks.fails_accepted_values("status", ["completed", "Returned"]),
                "source_not_accepted": checks.fails_not_accepted_values("traffic_source", ["direct"]),
                "items_in_range": checks.fails_range("item_count", 2, 5, inclusive=False),
                "discount_is_small": checks.fails_expression("discount_amount < 100"),
                "payment_not_empty": checks.fails_not_empty_string("payment_method"),
            },
        ),
        oracle.query("""
        , c AS (SELECT count(*) FILTER (campaign_id IS NULL) AS campaign_not_null, count(*) FILTER (customer_id IS NULL) AS customer_not_null,
                       count(*) FILTER (status NOT IN ('completed', 'Returned')) AS status_accepted,
                       count(*) FILTER (traffic_source = 'direct') AS source_not_accepted,
                       count(*) FILTER (item_count <= 2 OR item_count >= 5) AS items_in_range,
                       count(*) FILTER (NOT discount_amount < 100) AS discount_is_small,
                       count(*) FILTER (trim(payment_method) = '') AS payment_not_empty FROM raw_orders)
        SELECT name AS check_name, n AS failures, n = 0 AS passed FROM c UNPIVOT (n FOR name IN (COLUMNS(*)))"""),
    )
    register(
        "check_not_null",
        lambda s, d: checks.not_null(raw("raw_orders")(s, d), "campaign_id").select("order_id", "customer_id"),
        oracle.query("SELECT order_id, customer_id FROM raw_orders WHERE campaign_id IS NULL"),
    )
    register(
        "check_unique",
        lambda s, d: checks.unique(lineitem(s, d), "l_orderkey"),
        "SELECT l_orderkey, count(*) AS n_records FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    )
    register(
        "check_unique_combination",
        lambda s, d: checks.unique_combination_of_columns(lineitem(s, d), ["l_orderkey", "l_linenumber"]),
        "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n_records FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    )
    register(
        "check_accepted_values",
        lambda s, d: checks.accepted_values(given("events")(s, d), "event_type", ["signup", "purchase", "view"]),
        "SELECT event_type AS value_field, count(*) AS n_records FROM events WHERE event_type NOT IN ('signup', 'purchase', 'view') GROUP BY 1",
    )
    register(
        "check_not_accepted_values",
        lambda s, d: checks.not_accepted_values(given("events")(s, d), "event_type", ["error", "none"]),
        "SELECT DISTINCT event_type AS value_field FROM events WHERE event_type IN ('error', 'none')",
    )
    register(
        "check_relationships",
        lambda s, d: checks.relationships(orders(s, d), "o_orderkey", lineitem(s, d), "l_orderkey"),
        "SELECT o_orderkey AS id, count(*) AS n_records FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
    )
    register(
        "check_relationships_where",
        lambda s, d: checks.relationships_where(
            lineitem(s, d), "l_orderkey", orders(s, d), "o_orderkey", "l_returnflag = 'R'", "o_orderstatus <> 'P'"
        ),
        """SELECT l_orderkey AS id, count(*) AS n_records FROM lineitem WHERE l_returnflag = 'R'
           AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""",
    )
    register(
        "check_accepted_range",
        lambda s, d: checks.accepted_range(lineitem(s, d), "l_quantity", 3, 45).select("l_orderkey", "l_linenumber", "l_quantity"),
        "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3 OR l_quantity > 45",
    )
    register(
        "check_expression",
        lambda s, d: checks.expression_is_true(lineitem(s, d), "l_extendedprice >= l_quantity * 200").select(
            "l_orderkey", "l_linenumber", "l_extendedprice"
        ),
        """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM lineitem
           WHERE NOT (l_extendedprice >= l_quantity * 200)""",
    )
    register(
        "check_not_empty_string",
        lambda s, d: checks.not_empty_string(
            given("pages")(s, d).selectExpr("page_id", f"split_part({url_path('url')}, '/', 3) AS slug"), "slug"
        ),
        f"SELECT page_id, slug FROM (SELECT page_id, split_part({_PATH}, '/', 3) AS slug FROM pages) WHERE trim(slug) = ''",
    )
    register(
        "check_at_least_one",
        lambda s, d: checks.at_least_one(raw("raw_orders")(s, d), "discount_amount", ["item_count", "traffic_source"]),
        oracle.query("""SELECT item_count::BIGINT AS item_count, traffic_source, count(discount_amount) AS filler_column FROM raw_orders
                        GROUP BY 1, 2 HAVING count(discount_amount) = 0"""),
    )
    register(
        "check_not_constant",
        lambda s, d: checks.not_constant(orders(s, d), "o_orderstatus", ["o_custkey"]),
        "SELECT o_custkey, count(DISTINCT o_orderstatus) AS filler_column FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1",
    )
    register(
        "check_not_null_proportion",
        lambda s, d: checks.not_null_proportion(raw("raw_orders")(s, d), "campaign_id", 0.3, 0.32, ["store_id"]),
        oracle.query("""SELECT store_id, not_null_proportion FROM
            (SELECT store_id, count(campaign_id)::DOUBLE / count(*) AS not_null_proportion FROM raw_orders GROUP BY 1)
            WHERE not_null_proportion < 0.3::DOUBLE OR not_null_proportion > 0.32::DOUBLE"""),
    )
    register(
        "check_recency",
        lambda s, d: checks.recency(raw("raw_orders")(s, d), "order_date", "day", 200, AS_OF, True, ["customer_id"]),
        oracle.query(f"""SELECT customer_id, max(order_date)::VARCHAR AS most_recent, ({oracle.AS_OF} - 200)::VARCHAR AS threshold
                         FROM raw_orders GROUP BY 1 HAVING max(order_date) < {oracle.AS_OF} - 200"""),
    )
    register(
        "check_freshness",
        lambda s, d: checks.freshness(raw("raw_ad_spend")(s, d), dt.datetime(2001, 12, 1), 48),
        oracle.query("""SELECT (max(spend_date) + 1)::TIMESTAMP::VARCHAR AS most_recent, TIMESTAMP '2001-11-29 00:00:00'::VARCHAR AS threshold
                        FROM raw_ad_spend HAVING max(spend_date) + 1 < DATE '2001-11-29'"""),
    )
    register(
        "check_cardinality_equality",
        lambda s, d: checks.cardinality_equality(orders(s, d), "o_custkey", customer(s, d), "c_custkey"),
        """, a AS (SELECT o_custkey AS value, count(*) AS num_rows FROM orders GROUP BY 1),
           b AS (SELECT c_custkey AS value, count(*) AS num_rows FROM customer GROUP BY 1)
           SELECT *, true AS in_a FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
           SELECT *, false AS in_a FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""".replace(", a AS", "WITH a AS", 1),
    )

    def by_status(status: str) -> Query:
        return lambda s, d: raw("raw_orders")(s, d).filter(f"upper(status) = '{status}'")

    counts = """, a AS (SELECT store_id, traffic_source, count(*) AS n FROM stg_orders WHERE order_status = 'RETURNED' GROUP BY 1, 2),
           b AS (SELECT store_id, traffic_source, count(*) AS n FROM stg_orders WHERE order_status = 'CANCELLED' GROUP BY 1, 2)
        SELECT a.store_id AS store_id_a, b.store_id AS store_id_b, a.traffic_source AS traffic_source_a, b.traffic_source AS traffic_source_b,
               a.n AS count_a, b.n AS count_b, """
    joined = " FROM a FULL JOIN b ON a.store_id = b.store_id AND a.traffic_source = b.traffic_source"
    register(
        "check_equal_rowcount",
        lambda s, d: checks.equal_rowcount(by_status("RETURNED")(s, d), by_status("CANCELLED")(s, d), ["store_id", "traffic_source"]),
        oracle.query(counts + "abs(a.n - b.n) AS diff_count" + joined),
    )
    register(
        "check_fewer_rows_than",
        lambda s, d: checks.fewer_rows_than(by_status("RETURNED")(s, d), by_status("CANCELLED")(s, d), ["store_id", "traffic_source"]),
        oracle.query(counts + "CASE WHEN a.n > b.n THEN a.n - b.n WHEN a.n = b.n THEN 1 ELSE 0 END::BIGINT AS row_count_delta" + joined),
    )
    register(
        "check_equality",
        lambda s, d: checks.equality(*_customer_versions(s, d)),
        f"""WITH a AS ({_OLD}), b AS ({_NEW})
        SELECT 'a_minus_b' AS which_diff, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
        SELECT 'b_minus_a', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    )
    register(
        "check_equality_rounded",
        lambda s, d: checks.verdict(
            checks.equality(
                lineitem(s, d).selectExpr("l_orderkey", "l_extendedprice AS price"),
                lineitem(s, d).selectExpr("l_orderkey", "l_extendedprice + 0.3D AS price"),
                precision=0,
            ),
            "prices_equal_to_the_unit",
        ),
        """WITH a AS (SELECT DISTINCT l_orderkey, round(l_extendedprice::DECIMAL(12,2), 0) AS p FROM lineitem),
                b AS (SELECT DISTINCT l_orderkey, round(l_extendedprice::DECIMAL(12,2) + 0.3, 0) AS p FROM lineitem),
                n AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS x,
                             (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS y)
           SELECT 'prices_equal_to_the_unit' AS check_name, (x + y + abs(x - y))::BIGINT AS failures, x + y = 0 AS passed FROM n""",
    )

    def ranges_sql(source: str, part: str, less: str, gap: str) -> str:
        """Ranges of a part that are empty or reach the range after them, from numbered ranges and their successors."""
        part, key = part or "0", "part AS partition_by_col, " if part else ""
        return f"""SELECT {key}lower_bound{{cast}} AS lower_bound, upper_bound{{cast}} AS upper_bound, next_lower_bound{{cast}} AS next_lower_bound,
                          has_length, ends_before_next, count(*) AS copies
            FROM (WITH numbered AS (SELECT *, {part} AS part, row_number() OVER (PARTITION BY {part} ORDER BY lower_bound, upper_bound) AS place
                                    FROM ({source}))
                  SELECT here.*, after.lower_bound AS next_lower_bound, ifnull(here.lower_bound {less} here.upper_bound, false) AS has_length,
                         CASE WHEN after.place IS NULL THEN true ELSE ifnull(here.upper_bound {gap} after.lower_bound, false) END AS ends_before_next
                  FROM numbered AS here LEFT JOIN numbered AS after
                    ON here.part IS NOT DISTINCT FROM after.part AND after.place = here.place + 1)
            WHERE NOT has_length OR NOT ends_before_next GROUP BY ALL"""

    register(
        "check_exclusive_ranges",
        lambda s, d: checks.mutually_exclusive_ranges(
            raw("raw_orders")(s, d), "order_date", "date_add(order_date, item_count * 4)", "customer_id"
        ),
        oracle.query(
            ranges_sql(
                "SELECT customer_id, order_date AS lower_bound, order_date + (item_count * 4)::INT AS upper_bound FROM raw_orders",
                "customer_id",
                "<",
                "<=",
            ).format(cast="::VARCHAR")
        ),
    )
    register(
        "check_ranges_without_gaps",
        lambda s, d: checks.mutually_exclusive_ranges(
            orders(s, d), "o_orderkey * 10", "o_orderkey * 10 + if(o_orderstatus = 'P', 9, 10)", gaps="not_allowed"
        ),
        ranges_sql(
            "SELECT o_orderkey * 10 AS lower_bound, o_orderkey * 10 + CASE WHEN o_orderstatus = 'P' THEN 9 ELSE 10 END AS upper_bound FROM orders",
            "",
            "<",
            "=",
        ).format(cast="::BIGINT"),
    )
    sequence = """, w AS (SELECT {key} {col}, lag({col}) OVER ({over} ORDER BY {col}) AS previous_value FROM {source})
        SELECT {key} {col}{cast} AS {col}, previous_value{cast} AS previous_value, count(*) AS copies FROM w
        WHERE NOT ({col} = previous_value + 1) GROUP BY ALL"""
    register(
        "check_sequential_days",
        lambda s, d: checks.sequential_values(raw("raw_orders")(s, d), "order_date", 1, "day"),
        oracle.query(sequence.format(key="", col="order_date", over="", source="raw_orders", cast="::VARCHAR")),
    )
    register(
        "check_sequential_numbers",
        lambda s, d: checks.sequential_values(lineitem(s, d), "l_linenumber", 1, group_by=["l_orderkey"]),
        "WITH "
        + sequence.format(key="l_orderkey,", col="l_linenumber", over="PARTITION BY l_orderkey", source="lineitem", cast="::BIGINT").lstrip(", "),
    )
    register("declared_checks", lambda s, d: declared.run(_stored_facts(s, d)), _declared_sql())
    register("declared_checks_on_damage", lambda s, d: declared.run(_damaged(s, d), ("fct_orders", "dim_stores")), _declared_sql(damaged=True))


def _damaged(spark: SparkSession, folder: str) -> FactTables:
    """Orders with missing, repeated and unknown values, so that every kind of check has something to find."""
    tables = _stored_facts(spark, folder)
    orders = tables["fct_orders"].selectExpr(
        "* EXCEPT (order_id, customer_id, order_status, net_revenue)",
        "if(order_id % 50 = 1, order_id + 1, order_id) AS order_id",
        "if(customer_id % 40 = 3, -customer_id, customer_id) AS customer_id",
        "if(store_id = 5, 'LOST', order_status) AS order_status",
        "if(store_id = 7, NULL, net_revenue) AS net_revenue",
    )
    tables["fct_orders"] = orders
    return tables


def _declared_sql(damaged: bool = False) -> str:
    """The declared checks counted over the models, check by check."""
    models = {"dim_stores": "stores", "dim_dates": "calendar"}
    broken = """SELECT * REPLACE (CASE WHEN order_id % 50 = 1 THEN order_id + 1 ELSE order_id END AS order_id,
        CASE WHEN customer_id % 40 = 3 THEN -customer_id ELSE customer_id END AS customer_id,
        CASE WHEN store_id = 5 THEN 'LOST' ELSE order_status END AS order_status,
        CASE WHEN store_id = 7 THEN NULL ELSE net_revenue END AS net_revenue) FROM fct_orders"""
    parts = []
    for table, spec in declared.DECLARED.items():
        if damaged and table not in ("fct_orders", "dim_stores"):
            continue
        rows = f"({broken})" if damaged and table == "fct_orders" else models.get(table, table)

        def found(check: str, failures: str, table: str = table) -> None:
            parts.append(f"SELECT '{table}' AS table_name, '{check}' AS check_name, ({failures})::BIGINT AS failures")

        for c in spec.not_null:
            found(f"{c}_not_null", f"SELECT count(*) - count({c}) FROM {rows}")
        for c, values in (spec.values or {}).items():
            listed = ", ".join(f"'{v}'" for v in values)
            found(f"{c}_accepted_values", f"SELECT count(*) FROM {rows} WHERE {c} NOT IN ({listed})")
        for keys in [*[(c,) for c in spec.unique], *([spec.unique_together] if spec.unique_together else [])]:
            listed = ", ".join(keys)
            known = " AND ".join(f"{k} IS NOT NULL" for k in keys) if len(keys) == 1 else "true"
            found("_".join(keys) + "_unique", f"SELECT count(*) FROM (SELECT {listed} FROM {rows} WHERE {known} GROUP BY {listed} HAVING count(*) > 1)")
        for c, (to, field) in (spec.references or {}).items():
            found(f"{c}_in_{to}", f"SELECT count(DISTINCT {c}) FROM {rows} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {field} FROM {models.get(to, to)})")
    return oracle.query(f"SELECT *, failures = 0 AS passed FROM ({' UNION ALL '.join(parts)})")


# Two versions of the customer table: changed balances, blanked segments, removed and new keys.
_OLD = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
_NEW = """SELECT c_custkey + CASE WHEN c_custkey % 17 = 3 THEN 1000000000 ELSE 0 END AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey,
                 CASE WHEN c_custkey % 13 = 5 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
                 CASE WHEN c_custkey % 11 = 2 THEN NULL ELSE c_mktsegment END AS c_mktsegment
          FROM customer"""


def _customer_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    old = sample_retail.load(spark, folder, "customer").selectExpr(
        "c_custkey", "c_name", "bigint(c_nationkey) AS c_nationkey", "c_acctbal", "c_mktsegment"
    )
    new = old.selectExpr(
        "c_custkey + if(c_custkey % 17 = 3, 1000000000, 0) AS c_custkey",
        "c_name",
        "c_nationkey",
        "if(c_custkey % 13 = 5, c_acctbal + 1, c_acctbal) AS c_acctbal",
        "if(c_custkey % 11 = 2, NULL, c_mktsegment) AS c_mktsegment",
    )
    return old, new


# Line items before and after repricing; (order, line number) repeats, so keys are not unique.
_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem"
_LINES_NEW = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
                       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag
                FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01'"""


def _line_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = sample_retail.load(spark, folder, "lineitem")
    old = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    new = lines.filter("l_shipdate >= TIMESTAMP_NTZ'1995-06-01 00:00:00'").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "if(l_partkey % 7 = 0, l_quantity + 1, l_quantity) AS l_quantity",
        "if(l_partkey % 5 = 0, NULL, l_returnflag) AS l_returnflag",
    )
    return old, new


# Of a URL with scheme and host, the fourth and further parts between slashes.
_PATH = "array_to_string(string_split(split_part(url, '?', 1), '/')[4:], '/')"
_HOST = "split_part(split_part(replace(replace(replace(url, 'android-app://', ''), 'http://', ''), 'https://', ''), '/', 1), '?', 1)"


# Shaping.


def _landed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Raw orders landed as Parquet and read back with their declared schema."""
    place = fresh_path(spark, "landing")
    land({"raw_orders": sample_retail.retail_inputs(spark, folder)["raw_orders"]}, place)
    stored = spark.read.schema(ALL["raw_orders"]).parquet(f"{place}/landing/raw_orders")
    return stored.selectExpr("order_id", "string(order_date) AS order_date", "customer_id", "store_id", "status", "payment_method", "string(date(_loaded_at)) AS loaded_on")


def _stores_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The store catalogue written as CSV with a header row and read with its declared schema."""
    place = fresh_path(spark, "catalogue")
    sample_retail.retail_inputs(spark, folder)["catalog_stores"].write.option("header", True).csv(f"{place}/catalog_stores.csv")
    stores = read_table(spark, place, "catalog_stores", "csv")
    return stores.select("store_id", "store_name", "store_type", "channel", "city", "state", "region", "is_active")


def _spend_by_view(spark: SparkSession, folder: str) -> DataFrame:
    """Spend per channel and month, asked in SQL of a view over the staging plan."""
    named_view(staging.stg_ad_spend(sample_retail.retail_inputs(spark, folder), AS_OF), "marketing_ad_spend")
    return spark.sql(
        "SELECT channel, string(spend_month) AS spend_month, count(*) AS spends, double(sum(spend_usd)) AS spend FROM marketing_ad_spend GROUP BY channel, spend_month"
    )


def _orders_per_day(spark: SparkSession, folder: str) -> DataFrame:
    """Orders on every day from the first to the last one of the table."""
    orders = sample_retail.load(spark, folder, "orders").selectExpr("date(o_orderdate) AS day")
    first, last = orders.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return spark.createDataFrame([], "day string, orders long")
    days = shape.date_spine(spark, "day", first, last + dt.timedelta(days=1))
    counted = orders.groupBy("day").agg(F.count(F.lit(1)).alias("orders"))
    return days.join(counted, days.date_day == counted.day, "left").selectExpr("string(date_day) AS day", "coalesce(orders, 0L) AS orders")


def _register_shapes() -> None:
    register(
        "landed_orders",
        _landed_orders,
        oracle.query(
            "SELECT order_id, order_date::VARCHAR AS order_date, customer_id, store_id, status, payment_method, loaded_on::VARCHAR AS loaded_on FROM raw_orders"
        ),
    )
    register(
        "spend_by_view",
        _spend_by_view,
        oracle.query(
            """SELECT channel, date_trunc('month', spend_date)::DATE::VARCHAR AS spend_month, count(*) AS spends, sum(spend_usd)::DOUBLE AS spend
               FROM raw_ad_spend GROUP BY 1, 2"""
        ),
    )
    register("stores_from_csv", _stores_from_csv, oracle.query("SELECT * FROM stores"))
    register(
        "orders_per_day",
        _orders_per_day,
        """SELECT d::DATE::VARCHAR AS day, count(o_orderkey) AS orders
           FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS d FROM orders)
           LEFT JOIN orders ON o_orderdate::DATE = d GROUP BY 1""",
    )
    orders, lineitem, customer, events = given("orders"), given("lineitem"), given("customer"), given("events")
    register(
        "deduplicate",
        lambda s, d: shape.deduplicate(orders(s, d), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]),
        """SELECT * EXCLUDE (rn, o_orderdate), o_orderdate::VARCHAR AS o_orderdate FROM (SELECT *, row_number() OVER
           (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    )
    kinds = ["signup", "purchase", "view", "click", "error"]
    register(
        "pivot",
        lambda s, d: shape.pivot(events(s, d), ["user_id"], "event_type", kinds, prefix="n_"),
        "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in kinds) + " FROM events GROUP BY 1",
    )
    register(
        "pivot_distinct",
        lambda s, d: shape.pivot(
            events(s, d).selectExpr("date(ts) AS day", "event_type", "user_id"), ["day"], "event_type", kinds, agg="count",
            then_value="user_id", else_value=None, suffix="_users", distinct=True,
        ),
        "SELECT ts::DATE::VARCHAR AS day, "
        + ", ".join(f"count(DISTINCT user_id) FILTER (event_type = '{k}') AS {k}_users" for k in kinds)
        + " FROM events GROUP BY 1",
    )
    register(
        "unpivot",
        lambda s, d: shape.unpivot(given("part")(s, d), ["p_partkey"], ["p_retailprice"]),
        """SELECT p_partkey, field_name, value FROM (SELECT p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size FROM part)
           UNPIVOT INCLUDE NULLS (value FOR field_name IN (p_name, p_brand, p_type, p_size))""",
    )
    register(
        "union_tables",
        lambda s, d: shape.union_tables(
            {
                "customer": customer(s, d).selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment", "c_acctbal AS balance"),
                "supplier": given("supplier")(s, d).selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance", "s_nationkey AS nation"),
            },
            exclude=["Balance"],
            overrides={"nation": "string"},
            where="balance > 0",
        ),
        """SELECT 'customer' AS source_table, c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS nation FROM customer
           WHERE c_acctbal > 0 UNION ALL
           SELECT 'supplier', s_suppkey, s_name, NULL, s_nationkey::VARCHAR FROM supplier WHERE s_acctbal > 0""",
    )
    register(
        "surrogate_key",
        lambda s, d: shape.with_surrogate_key(
            raw("raw_orders")(s, d).select("order_id", "campaign_id", "traffic_source", "order_date"),
            ["order_id", "campaign_id", "traffic_source", "order_date"],
        ),
        oracle.query("""SELECT order_id, campaign_id, traffic_source, order_date::VARCHAR AS order_date,
            md5(order_id::VARCHAR || '-' || coalesce(campaign_id::VARCHAR, '""" + NULL_KEY_TOKEN + """') || '-' || traffic_source
                || '-' || order_date::VARCHAR) AS surrogate_key FROM raw_orders"""),
    )
    register(
        "star",
        lambda s, d: shape.star(customer(s, d), ["C_ACCTBAL", "c_name"], prefix="old_", suffix="_x"),
        "SELECT c_custkey AS old_c_custkey_x, c_nationkey::BIGINT AS old_c_nationkey_x, c_mktsegment AS old_c_mktsegment_x FROM customer",
    )
    register(
        "blank_to_null",
        lambda s, d: shape.blank_to_null(
            given("pages")(s, d).selectExpr("page_id", "split_part(url, '?', 2) AS query", "split_part(url, '#', 2) AS fragment")
        ),
        "SELECT page_id, nullif(split_part(url, '?', 2), '') AS query, nullif(split_part(url, '#', 2), '') AS fragment FROM pages",
    )
    register(
        "column_values",
        lambda s, d: shape.column_values(lineitem(s, d), "l_partkey", "l_returnflag = 'R'", max_records=50),
        """SELECT l_partkey AS value, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY n DESC, value LIMIT 50""",
    )
    register(
        "safe_arithmetic",
        lambda s, d: raw("raw_orders")(s, d).selectExpr(
            "order_id",
            f"{safe_add('discount_amount', 'item_count')} AS added",
            f"{safe_subtract('item_count', 'campaign_id', 'discount_amount')} AS subtracted",
            f"{safe_divide('discount_amount', 'campaign_id')} AS divided",
        ),
        oracle.query("""SELECT order_id, (coalesce(discount_amount, 0) + coalesce(item_count, 0))::DOUBLE AS added,
            (coalesce(item_count, 0) - coalesce(campaign_id, 0) - coalesce(discount_amount, 0))::DOUBLE AS subtracted,
            discount_amount::DOUBLE / nullif(campaign_id, 0)::DOUBLE AS divided FROM raw_orders"""),
    )
    register(
        "histogram",
        lambda s, d: shape.histogram(lineitem(s, d), "l_extendedprice", 1000, 90000, 20),
        """SELECT CASE WHEN l_extendedprice < 1000 THEN 0 WHEN l_extendedprice >= 90000 THEN 21
                       ELSE floor((l_extendedprice - 1000) * 20 / 89000) + 1 END::BIGINT AS bucket,
                  count(*) AS n, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value FROM lineitem GROUP BY 1""",
    )
    register(
        "url_report",
        lambda s, d: url_report(given("pages")(s, d)),
        f"""SELECT {_HOST} AS host, nullif(split_part(split_part(url, 'utm_source=', 2), '&', 1), '') AS utm_source,
                   split_part({_PATH}, '/', 1) AS section, count(*) AS pages FROM pages GROUP BY 1, 2, 3""",
    )


# Diffs.


def _register_diffs() -> None:
    customers, lines = _customer_versions, _line_versions
    found = """, f AS (SELECT *, true AS in_a, true AS in_b FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
                    SELECT *, true, false FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
                    SELECT *, false, true FROM (SELECT * FROM b EXCEPT SELECT * FROM a))"""
    summary = " SELECT in_a, in_b, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent_of_total FROM f GROUP BY 1, 2"
    register("diff_summary", lambda s, d: diff.compare_rows(*customers(s, d)), f"WITH a AS ({_OLD}), b AS ({_NEW}){found}{summary}")
    register("diff_summary_lines", lambda s, d: diff.compare_rows(*lines(s, d)), f"WITH a AS ({_LINES}), b AS ({_LINES_NEW}){found}{summary}")
    register(
        "diff_summary_excluding",
        lambda s, d: diff.compare_rows(*customers(s, d), exclude=["c_acctbal"]),
        f"WITH a AS (SELECT * EXCLUDE (c_acctbal) FROM ({_OLD})), b AS (SELECT * EXCLUDE (c_acctbal) FROM ({_NEW})){found}{summary}",
    )
    register(
        "diff_rows",
        lambda s, d: diff.row_differences(*customers(s, d)),
        f"WITH a AS ({_OLD}), b AS ({_NEW}){found} SELECT * FROM f WHERE NOT (in_a AND in_b)",
    )
    register(
        "diff_rows_first",
        lambda s, d: diff.row_differences(*customers(s, d), order_by=["c_custkey"], limit=25),
        f"WITH a AS ({_OLD}), b AS ({_NEW}){found} SELECT * FROM f WHERE NOT (in_a AND in_b) ORDER BY c_custkey, in_a DESC, in_b DESC LIMIT 25",
    )

    def joined(a: str, b: str, key: str) -> str:
        return f"WITH a AS (SELECT *, {key} AS pk FROM ({a})), b AS (SELECT *, {key} AS pk FROM ({b})), j AS (SELECT a, b, a.pk AS apk, b.pk AS bpk FROM a FULL JOIN b ON a.pk = b.pk)"

    def status(c: str) -> str:
        # The texts are fixed values. A pair's state: equal (two NULLs are), else a missing row, else a NULL, else different.
        return f"""SELECT '{c}' AS column_name, match_status, count(*) AS count_records,
                round(100.0 * count(*) / (SELECT count(*) FROM j), 2)::DOUBLE AS percent_of_total
            FROM (SELECT CASE WHEN a.{c} IS NOT DISTINCT FROM b.{c} THEN '✅: ' || if(a.{c} IS NULL, 'both are null', 'perfect match')
                              WHEN apk IS NULL OR bpk IS NULL THEN '🤷: missing from ' || if(apk IS NULL, 'a', 'b')
                              WHEN a.{c} IS NULL OR b.{c} IS NULL THEN '🤷: value is null in ' || if(a.{c} IS NULL, 'a', 'b') || ' only'
                              ELSE '❌: values do not match' END AS match_status FROM j) GROUP BY 2"""

    def flags(c: str) -> str:
        return f"""SELECT ifnull(apk, bpk) AS primary_key, upper('{c}') AS column_name, paired AND same AS perfect_match,
                apk IS NOT NULL AND x IS NULL AS null_in_a, bpk IS NOT NULL AND y IS NULL AS null_in_b,
                apk IS NULL AS missing_from_a, bpk IS NULL AS missing_from_b, paired AND NOT same AS conflicting_values
            FROM (SELECT apk, bpk, a.{c} AS x, b.{c} AS y, apk IS NOT NULL AND bpk IS NOT NULL AS paired,
                         a.{c} IS NOT DISTINCT FROM b.{c} AS same FROM j)"""

    names = ["perfect_match", "null_in_a", "null_in_b", "missing_from_a", "missing_from_b", "conflicting_values"]
    sums = ", ".join(f"count(*) FILTER ({n}) AS {n}" for n in names)
    customer_columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    line_columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"]
    pair = joined(_OLD, _NEW, "c_custkey")
    line_key = "l_orderkey * 10 + l_linenumber"
    line_pair = joined(_LINES, _LINES_NEW, line_key)
    register("diff_column", lambda s, d: diff.compare_column(*customers(s, d), "c_custkey", "c_mktsegment"), f"{pair} {status('c_mktsegment')}")
    register(
        "diff_column_repeated_keys",
        lambda s, d: diff.compare_column(*lines(s, d), line_key, "l_returnflag"),
        f"{line_pair} {status('l_returnflag')}",
    )
    register(
        "diff_columns",
        lambda s, d: diff.compare_all_columns(*customers(s, d), "c_custkey"),
        f"{pair} SELECT column_name, {sums} FROM ({' UNION ALL '.join(map(flags, customer_columns))}) GROUP BY 1",
    )
    register(
        "diff_columns_repeated_keys",
        lambda s, d: diff.compare_all_columns(*lines(s, d), line_key, exclude=["L_PARTKEY"]),
        f"{line_pair} SELECT column_name, {sums} FROM ({' UNION ALL '.join(flags(c) for c in line_columns if c != 'l_partkey')}) GROUP BY 1",
    )
    register(
        "diff_columns_rows",
        lambda s, d: diff.compare_all_columns(*customers(s, d), "c_custkey", summarize=False),
        f"{pair} SELECT *, count(*) AS row_count FROM ({' UNION ALL '.join(map(flags, customer_columns))}) GROUP BY ALL",
    )
    classified = """, r AS (SELECT row_key, a, b, {cols}, sum(a) OVER w AS n_a, sum(b) OVER w AS n_b FROM
            (SELECT {key} AS row_key, {cols}, sum(x)::BIGINT AS a, sum(y)::BIGINT AS b FROM
              (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY ALL) WINDOW w AS (PARTITION BY row_key)),
          c AS (SELECT *, CASE WHEN n_a > 1 OR n_b > 1 THEN 'nonunique_pk' WHEN a = 1 AND b = 1 THEN 'identical'
                       WHEN n_a = 1 AND n_b = 1 THEN 'modified' WHEN a = 1 THEN 'removed' ELSE 'added' END AS row_status FROM r),
          s AS (SELECT row_status, sum(n)::BIGINT AS num_rows_in_status FROM
                 (SELECT DISTINCT row_status, row_key, greatest(n_a, n_b) AS n FROM c) GROUP BY 1)"""
    key_sql = "md5(c_custkey::VARCHAR)"
    register(
        "diff_classify",
        lambda s, d: diff.classify_rows(*customers(s, d), ["c_custkey"]).drop("copy_number"),
        f"WITH a AS ({_OLD}), b AS ({_NEW})"
        + classified.format(key=key_sql, cols=", ".join(customer_columns))
        + f"SELECT row_status, {', '.join(customer_columns)}, row_key, in_a, in_b, num_rows_in_status FROM"
        " (SELECT *, unnest(generate_series(1, greatest(a, b))) AS i, i <= a AS in_a, i <= b AS in_b FROM c) JOIN s USING (row_status)",
    )
    register(
        "diff_classify_sample",
        lambda s, d: diff.classify_rows(*customers(s, d), ["c_custkey"], sample_limit=20).drop("copy_number"),
        f"WITH a AS ({_OLD}), b AS ({_NEW})"
        + classified.format(key=key_sql, cols=", ".join(customer_columns))
        + f"SELECT row_status, {', '.join(customer_columns)}, row_key, a = 1 AS in_a, b = 1 AS in_b, sample_number, num_rows_in_status FROM"
        " (SELECT *, dense_rank() OVER (PARTITION BY row_status ORDER BY row_key) AS sample_number FROM c) JOIN s USING (row_status)"
        " WHERE sample_number <= 20",
    )
    both = ["c_custkey", "c_acctbal", "c_mktsegment"]
    register(
        "diff_classify_shared_columns",
        lambda s, d: (lambda old, new: diff.classify_rows(
            old.withColumn("note", F.lit("old")).drop("c_nationkey"), new.withColumn("rank", F.lit(1)).drop("c_name"), ["c_custkey"]
        ).drop("copy_number"))(*customers(s, d)),
        f"WITH a AS (SELECT {', '.join(both)} FROM ({_OLD})), b AS (SELECT {', '.join(both)} FROM ({_NEW}))"
        + classified.format(key=key_sql, cols=", ".join(both))
        + f"SELECT row_status, {', '.join(both)}, row_key, in_a, in_b, num_rows_in_status FROM"
        " (SELECT *, unnest(generate_series(1, greatest(a, b))) AS i, i <= a AS in_a, i <= b AS in_b FROM c) JOIN s USING (row_status)",
    )
    line_cols = ", ".join(line_columns)
    register(
        "diff_classify_lines",
        lambda s, d: diff.classify_rows(*lines(s, d), ["l_orderkey", "l_linenumber"]).select(
            "row_status", *line_columns, "in_a", "in_b", "num_rows_in_status"
        ),
        f"WITH a AS ({_LINES}), b AS ({_LINES_NEW})"
        + classified.format(key="md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR)", cols=line_cols)
        + "SELECT row_status, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_quantity, l_returnflag, in_a, in_b,"
        " num_rows_in_status FROM (SELECT *, unnest(generate_series(1, greatest(a, b))) AS i, i <= a AS in_a, i <= b AS in_b FROM c)"
        " JOIN s USING (row_status)",
    )

    def differ(a: str, b: str, on: str, cols: list[str]) -> str:
        tests = " UNION ALL ".join(f"SELECT '{c}' AS column_name, bool_or(a.{c} IS DISTINCT FROM b.{c}) AS has_difference FROM j" for c in cols)
        return f"WITH a AS ({a}), b AS ({b}), j AS (SELECT a, b FROM a JOIN b ON {on}) {tests}"

    register(
        "which_columns_differ",
        lambda s, d: diff.which_columns_differ(*customers(s, d), ["c_custkey"]),
        differ(_OLD, _NEW, "a.c_custkey = b.c_custkey", customer_columns),
    )
    register(
        "which_columns_differ_lines",
        lambda s, d: diff.which_columns_differ(*lines(s, d), ["l_orderkey", "l_linenumber"]),
        differ(_LINES, _LINES_NEW, "a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", line_columns),
    )
    register(
        "tables_identical",
        lambda s, d: diff.tables_identical(*lines(s, d)).selectExpr("'repriced' AS pair", "*").unionByName(
            diff.tables_identical(lines(s, d)[0], lines(s, d)[0].orderBy("l_partkey")).selectExpr("'reordered' AS pair", "*")
        ),
        f"""WITH a AS ({_LINES}), b AS ({_LINES_NEW})
            SELECT 'repriced' AS pair, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) +
                   (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0 AS are_tables_identical
            UNION ALL SELECT 'reordered', true""",
    )
    register(
        "diff_row_counts",
        lambda s, d: diff.row_counts(dict(zip(["old", "new"], lines(s, d)))),
        f"SELECT 'old' AS relation_name, count(*) AS total_records FROM ({_LINES}) UNION ALL SELECT 'new', count(*) FROM ({_LINES_NEW})",
    )

    def order_versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
        orders = sample_retail.load(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        old = orders.filter("o_orderdate < TIMESTAMP_NTZ'2000-06-01 00:00:00'")
        new = orders.filter("o_orderdate >= TIMESTAMP_NTZ'1996-03-01 00:00:00'").selectExpr(
            "o_orderkey", "o_custkey", "if(o_custkey % 9 = 0, 'X', o_orderstatus) AS o_orderstatus", "o_orderdate"
        )
        return old, new

    register(
        "diff_common_period",
        lambda s, d: diff.classify_rows(*order_versions(s, d), ["o_orderkey"], event_time="o_orderdate")
        .groupBy("row_status", "num_rows_in_status", "in_a", "in_b")
        .agg(F.expr("count(*) AS rows"), F.expr("min(o_orderdate) AS first_day"), F.expr("max(o_orderdate) AS last_day")),
        """WITH x AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-06-01'), y AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01'),
             z AS (SELECT CASE WHEN o_custkey % 9 = 0 THEN 'modified' ELSE 'identical' END AS row_status, o_orderdate FROM orders
                   WHERE o_orderdate BETWEEN (SELECT min(o_orderdate) FROM y) AND (SELECT max(o_orderdate) FROM x))
           SELECT row_status, count(*) AS num_rows_in_status, in_a, in_b, count(*) AS rows, min(o_orderdate)::VARCHAR AS first_day,
                  max(o_orderdate)::VARCHAR AS last_day
           FROM (SELECT *, true AS in_a, true AS in_b FROM z WHERE row_status = 'identical' UNION ALL
                 SELECT *, true, false FROM z WHERE row_status = 'modified' UNION ALL
                 SELECT *, false, true FROM z WHERE row_status = 'modified') GROUP BY row_status, in_a, in_b""",
    )


# Maintenance. Tables are written below the shared folder, one fresh path per run.


#: Bytes of lines, as the planner expects them, for each shuffle partition from which on tasks write rows as they lie.
LEAST_BYTES = 1 << 18


def _deals(spark: SparkSession, folder: str) -> bool:
    """Whether the lines are so few that tasks would leave tiny files if rows were not brought together first."""
    lines = sample_retail.retail_inputs(spark, folder)["raw_order_items"]
    expected = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return expected < LEAST_BYTES * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _by_order(df: DataFrame, path: str, append: bool = False) -> DataFrame:
    """Rows landed in buckets by order, as a table: whoever joins or groups them by order does not deal them out again. Spark
    deals rows out that lie in fewer buckets than shuffles have partitions, so there are as many."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(df, path.rpartition("/")[2].replace("-", "_"), path, "order_id", buckets, append=append)


def _landed(spark: SparkSession, folder: str, line_ids: bool = True) -> dict[str, DataFrame]:
    """The tables of orders, landed once for all runs of a query; a run reads what was loaded before it. Without ``line_ids``
    lines are not numbered, for results that show none."""
    inputs = sample_retail.retail_inputs(spark, folder)
    if not line_ids:
        inputs["raw_order_items"] = inputs["raw_order_items"].drop("order_item_id")
    landed = {name: _by_order(inputs[name], fresh_path(spark, name)) for name in increments.ORDER_TABLES}
    if not line_ids:
        landed["raw_order_items"] = landed["raw_order_items"].withColumn("order_item_id", F.lit(None).cast("bigint"))
    return landed


@contextlib.contextmanager
def _staying_by_order(spark: SparkSession) -> Iterator[None]:
    """Lines that lie by order stay there when they meet pairs of order and product."""
    whole = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(whole)
    spark.conf.set(whole, "false")
    try:
        yield
    finally:
        spark.conf.set(whole, before)


def _in_steps(
    name: str,
    keys: list[str],
    partition: str,
    cuts: list[str],
    visible: Callable[[sample_retail.LazyInputs, str], None],
    full: Callable[[sample_retail.LazyInputs], DataFrame],
    increment: Callable[[sample_retail.LazyInputs, DataFrame, dt.date | None], DataFrame],
    make: Callable[[SparkSession, str], sample_retail.LazyInputs] = sample_retail.retail_inputs,
    target_where: str | None = None,
    keys_stay: bool = True,
    whole_partitions: bool = False,
) -> Query:
    """Build a table in several runs, each seeing more of the source than the one before; a run
    knows the day of the last one from the table's mark."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        table = KeyedTable(spark, fresh_path(spark, name), keys, partition, keys_stay=keys_stay)
        for cut in cuts:
            inputs = make(spark, folder)
            visible(inputs, cut)
            since = table.mark() and dt.date.fromisoformat(table.mark())
            rows = increment(inputs, table.read(), since) if table.exists() else full(inputs)
            table.upsert(rows, target_where, mark=cut, whole_partitions=whole_partitions)
        return table.read()

    return run


def _loaded_before(inputs: sample_retail.LazyInputs, cut: str) -> None:
    """Of every table that carries load times, what was loaded before a day."""
    for name in (*increments.ORDER_TABLES, "raw_ad_spend", "raw_events"):
        inputs[name] = inputs[name].filter(f"_loaded_at < DATE'{cut}'")


def _opening_stock(inputs: sample_retail.LazyInputs) -> DataFrame:
    """Stock at the start: what was ever sold of the product in the store, and some spare units."""
    sold = core.inventory_movements(inputs, AS_OF).groupBy("product_id", "store_id")
    return sold.agg(F.expr("sum(units_sold_today) + product_id % 400 AS opening_units"))


def _inventory_last_week(spark: SparkSession, folder: str) -> DataFrame:
    """The increment after a table that ends a week before the run."""
    inputs = sample_retail.retail_inputs(spark, folder)
    ends = spark.range(1).selectExpr("DATE'2001-07-26' AS snapshot_date")
    return increments.inventory_increment(inputs, AS_OF, ends, _opening_stock(inputs), FIRST)


def _inventory_in_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The daily stock as a table over runs that see what was loaded before them; one run is repeated."""
    table = KeyedTable(spark, fresh_path(spark, "inventory"), ["product_id", "store_id", "snapshot_date"], "snapshot_date", keys_stay=True, deal=False)
    opening = written(_opening_stock(sample_retail.retail_inputs(spark, folder)), "opening-stock")
    first = dt.date(2001, 7, 24)
    for cut in ["2001-07-27", "2001-07-30", "2001-07-30", "2100-01-01"]:
        inputs = sample_retail.retail_inputs(spark, folder)
        _loaded_before(inputs, cut)
        last = min(dt.date.fromisoformat(cut) - dt.timedelta(days=1), AS_OF)
        if table.exists():
            since = dt.date.fromisoformat(table.mark())
            rows = increments.inventory_increment(inputs, last, table.read(), opening, first, loaded_since=since)
        else:
            rows = core.inventory_daily(inputs, last, opening, first)
        table.upsert(rows, mark=cut)
    return table.read()


SNAPSHOTS = [dt.date(1998, 1, 1), dt.date(2000, 1, 1), dt.date(2001, 8, 2)]
TRACKED = ["customer_segment", "customer_lifecycle_stage", "customer_value_tier", "total_orders", "last_order_date"]


def _customer_snapshot(spark: SparkSession, folder: str, at: dt.date, number: int) -> DataFrame:
    """Customers as of a day; the second delivery lacks some, which come back in the third."""
    inputs = sample_retail.retail_inputs(spark, folder)
    inputs["raw_orders"] = inputs["raw_orders"].filter(f"order_date < DATE'{at}'")
    customers = enrich.customers_with_orders(inputs, at).select("customer_id", "full_name", *TRACKED, "is_email_subscribed")
    return customers.filter("customer_id % 23 <> 4") if number == 1 else customers


def _customer_history(spark: SparkSession, folder: str) -> DataFrame:
    kept = history.HistoryTable(spark, fresh_path(spark, "history"), "customer_id", [*TRACKED, "is_email_subscribed"])
    for number, at in enumerate(SNAPSHOTS):
        kept.snapshot(_customer_snapshot(spark, folder, at, number), at)
    return kept.read()


_SNAPSHOT_SQL = """, cut AS (SELECT * FROM (VALUES (0, DATE '1998-01-01'), (1, DATE '2000-01-01'), (2, DATE '2001-08-02')) AS c(i, cut_day)),
  o AS (SELECT i, customer_id, count(*) AS n, max(order_date) AS last_day, sum(CASE WHEN is_completed THEN net_revenue ELSE 0 END) AS net
        FROM fct_orders JOIN cut ON order_date < cut_day GROUP BY 1, 2),
  seen AS (SELECT c.i, c.cut_day, k.customer_id, k.full_name, k.customer_segment, k.is_email_subscribed, coalesce(o.n, 0) AS total_orders,
                  o.last_day AS last_order_date,
                  CASE WHEN o.n IS NULL THEN 'never_purchased' WHEN o.last_day >= c.cut_day - 90 THEN 'active'
                       WHEN o.last_day >= c.cut_day - 180 THEN 'at_risk' ELSE 'churned' END AS customer_lifecycle_stage,
                  CASE WHEN coalesce(o.net, 0) >= 1000 THEN 'high_value' WHEN coalesce(o.net, 0) >= 300 THEN 'mid_value'
                       WHEN coalesce(o.net, 0) > 0 THEN 'low_value' ELSE 'no_purchases' END AS customer_value_tier
           FROM stg_customers k CROSS JOIN cut c LEFT JOIN o ON o.customer_id = k.customer_id AND o.i = c.i
           WHERE NOT (c.i = 1 AND k.customer_id % 23 = 4)),
  marked AS (SELECT *, lag(i) OVER w IS DISTINCT FROM i - 1 OR lag((total_orders, last_order_date, customer_lifecycle_stage, customer_value_tier)) OVER w
                    IS DISTINCT FROM (total_orders, last_order_date, customer_lifecycle_stage, customer_value_tier) AS starts
             FROM seen WINDOW w AS (PARTITION BY customer_id ORDER BY i)),
  runs AS (SELECT *, sum(starts::INT) OVER (PARTITION BY customer_id ORDER BY i) AS run FROM marked),
  versions AS (SELECT customer_id, run, any_value(full_name) AS full_name, any_value(customer_segment) AS customer_segment,
                      any_value(customer_lifecycle_stage) AS customer_lifecycle_stage, any_value(customer_value_tier) AS customer_value_tier,
                      any_value(total_orders) AS total_orders, any_value(last_order_date) AS last_order_date,
                      any_value(is_email_subscribed) AS is_email_subscribed, min(cut_day) AS valid_from,
                      (SELECT cut_day FROM cut WHERE cut.i = max(runs.i) + 1) AS valid_to FROM runs GROUP BY 1, 2)"""
_VERSION_COLUMNS = """customer_id, full_name, customer_segment, customer_lifecycle_stage, customer_value_tier, total_orders,
  last_order_date::VARCHAR AS last_order_date, is_email_subscribed, valid_from::TIMESTAMP::VARCHAR AS valid_from,
  valid_to::TIMESTAMP::VARCHAR AS valid_to"""


def _arriving(df: DataFrame, label: str, conditions: list[str], run: Callable[[str], StreamingQuery]) -> None:
    """Let the rows of ``df`` arrive one condition after the other, each as the files of a folder of its own, and run a
    query over what is new each time. The query finds its place by its checkpoint."""
    path = fresh_path(df.sparkSession, label)
    for number, condition in enumerate(conditions):
        df.filter(condition).write.parquet(f"{path}/arrival={number}")
        run(f"{path}/*").awaitTermination()


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


#: Parts of the month of the events, in an order that brings rows up to two weeks late.
_BY_WEEK = ["dayofmonth(ts) BETWEEN 8 AND 15", "dayofmonth(ts) < 8", "dayofmonth(ts) > 22", "dayofmonth(ts) BETWEEN 16 AND 22"]


def _stream_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Event purchases arriving as a stream, upserted per customer: the latest purchase wins. They arrive in
    four batches that run against the order of time."""
    events = given("events")(spark, folder).filter("event_type = 'purchase'").selectExpr("user_id", "event_id", "ts", "value", "user_id % 16 AS bucket")
    table = KeyedTable(spark, fresh_path(spark, "latest_purchase"), ["user_id"], "bucket", "bigint", keys_stay=True)
    offsets = fresh_path(spark, "offsets")

    def run(path: str) -> StreamingQuery:
        return flows.upsert_stream(flows.read_stream(spark, path, _schema(events)), table, ["ts", "event_id"], offsets)

    _arriving(events, "arrivals", [f"dayofyear(ts) % 4 = {part}" for part in (3, 0, 2, 1)], run)
    return table.read().select("user_id", "event_id", "value")


def _stream_credits(spark: SparkSession, folder: str) -> tuple[KeyedTable, KeyedTable, DataFrame]:
    """Credits of key-days and channel months, kept while the events arrive out of order; and the credited orders."""
    events = given("events")(spark, folder)
    credits = KeyedTable(spark, fresh_path(spark, "credits"), ["customer_id", "order_date"], "order_date", keys_stay=True)
    months = KeyedTable(spark, fresh_path(spark, "channel_months"), ["attributed_channel", "order_month"], "order_month", keys_stay=True)
    offsets = fresh_path(spark, "offsets")

    def orders_of(landed: DataFrame) -> DataFrame:
        """Credited orders, from the events that have arrived."""
        read = lambda name: landed if name == "events" else sample_retail.load(spark, folder, name)
        tables = {"raw_orders": sample_retail.web_orders, "raw_order_items": sample_retail.web_order_items}
        inputs = {name: make(read) for name, make in tables.items()}
        inputs |= {"raw_returns": sample_retail.raw_returns(read).filter("false"), "catalog_stores": sample_retail.catalog_stores(read)}
        orders = marketing.completed_orders(inputs, AS_OF)
        return marketing.credited_touches(attribution.credited(orders, credits.read(), "customer_id", "order_date"))

    def run(path: str) -> StreamingQuery:
        stream = lambda _: flows.read_stream(spark, path, _schema(events))
        pairs = attribution.touch_pairs(
            sample_retail.web_orders(stream).select("customer_id", "order_date"),
            marketing.touch_events({"raw_events": sample_retail.raw_events(stream)}),
            "customer_id", "order_date", "event_date", marketing.TOUCH_ORDER, marketing.LOOKBACK_DAYS, late="21 days",
        )

        def sum_again(changed: DataFrame) -> None:
            touched = changed.selectExpr("trunc(order_date, 'month') AS month").distinct()
            orders = orders_of(spark.read.schema(_schema(events)).parquet(path))
            orders = orders.join(touched, F.expr("trunc(order_date, 'month') = month"), "left_semi")
            months.upsert(marketing.channel_attribution({"attribution_touchpoints": orders}, AS_OF), whole_partitions=True)

        return attribution.maintain_last_touch(pairs, credits, "event_date", marketing.TOUCH_ORDER, offsets, sum_again)

    _arriving(events, "arrivals", _BY_WEEK, run)
    return credits, months, orders_of(events)


def _stream_order_items(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and orders land in different orders; every batch builds the lines of the orders it touches."""
    inputs = sample_retail.retail_inputs(spark, folder)
    paths = {name: fresh_path(spark, name) for name in ("raw_orders", "raw_order_items")}
    schemas = {name: _schema(inputs[name]) for name in paths}
    table = KeyedTable(spark, fresh_path(spark, "fct_order_items"), ["order_item_id"], "order_month", keys_stay=True, deal=_deals(spark, folder))
    offsets = fresh_path(spark, "offsets")

    tables: dict[str, DataFrame] = {}

    def build(keys: DataFrame) -> DataFrame:
        narrowed = increments.of_orders(replaced(inputs, **tables), keys)
        return core.fct_order_items(replaced(narrowed, order_items_enriched=enrich.order_items_by_order(narrowed, AS_OF)), AS_OF)

    for number, (orders, lines) in enumerate([(0, 2), (2, 1), (1, 0)]):
        for name, part in (("raw_orders", orders), ("raw_order_items", lines)):
            tables[name] = _by_order(inputs[name].filter(f"order_id % 3 = {part}"), paths[name], append=number > 0)
        feeds = [flows.read_stream(spark, paths[name], schemas[name]).select("order_id") for name in paths]
        with _staying_by_order(spark):
            flows.follow_parents(feeds[0].unionByName(feeds[1]), "order_id", build, table, offsets).awaitTermination()
    return table.read()


def _stream_closed_days(spark: SparkSession, folder: str) -> DataFrame:
    """Store days that the watermark has closed, each once, and beside them what came too late for its day."""
    bought = given("events")(spark, folder).filter("event_type = 'purchase'").selectExpr(
        "event_id", "timestamp(ts) AS ts", "event_id % 25 AS store_id", f"cast(value AS {MONEY}) AS value"
    )
    closed = KeyedTable(spark, fresh_path(spark, "closed_days"), ["store_id", "day"], "day", keys_stay=True)
    late = KeyedTable(spark, fresh_path(spark, "late_rows"), ["event_id"], "day", keys_stay=True)
    offsets = [fresh_path(spark, "offsets") for _ in range(2)]

    def run(path: str) -> StreamingQuery:
        rows = flows.read_stream(spark, path, _schema(bought))
        daily = flows.daily_totals(rows, "ts", ["store_id"], ["count(*) AS orders", "sum(value) AS revenue"], late="3 days")
        flows.closed_totals(daily, closed, offsets[0]).awaitTermination()
        return flows.keep_late(rows.withColumn("day", F.to_date("ts")), "ts", late, offsets[1], late_days=3)

    _arriving(bought, "arrivals", _BY_WEEK, run)
    came_late = late.read().groupBy("store_id", "day").agg(F.expr("count(*) AS late_orders"), F.expr("sum(value) AS late_revenue"))
    both = closed.read().join(came_late, ["store_id", "day"], "full_outer")
    total = lambda a, b, name: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(name)
    return both.select("store_id", "day", total("orders", "late_orders", "orders"), total("revenue", "late_revenue", "revenue"))


def _stream_store_days(spark: SparkSession, folder: str) -> DataFrame:
    events = flows.read_stream(spark, f"{folder}/[e]vents.parquet", sample_retail.SOURCES["events"])
    bought = events.filter("event_type = 'purchase'").selectExpr(
        "timestamp(ts) AS ts", "event_id % 25 AS store_id", f"cast(value AS {MONEY}) AS value"
    )
    daily = flows.daily_totals(bought, "ts", ["store_id"], ["count(*) AS orders", "sum(value) AS revenue"])
    table = KeyedTable(spark, fresh_path(spark, "store_days"), ["store_id", "day"], "day")
    flows.maintain_daily_totals(daily, table, fresh_path(spark, "offsets")).awaitTermination()
    return table.read()


def _register_maintenance() -> None:
    changed = "c_custkey >= 1000000000 OR c_custkey % 13 = 5 OR c_custkey % 11 = 2"

    def customer_updates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
        old, new = _customer_versions(s, d)
        return old, new.filter(changed)

    after = f"WITH a AS ({_OLD}), u AS (SELECT * FROM ({_NEW}) WHERE {changed})"
    register(
        "upsert_result",
        lambda s, d: merged(*customer_updates(s, d), ["c_custkey"]),
        f"{after} SELECT * FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM u) UNION ALL SELECT * FROM u",
    )
    register(
        "upsert_bounded",
        lambda s, d: merged(*customer_updates(s, d), ["c_custkey", "c_nationkey"], target_where="c_nationkey >= 10"),
        f"""{after} SELECT * FROM a WHERE c_nationkey < 10 OR (c_custkey, c_nationkey) NOT IN (SELECT (c_custkey, c_nationkey) FROM u)
            UNION ALL SELECT * FROM u""",
    )
    register(
        "upsert_new_columns",
        lambda s, d: merged(
            customer_updates(s, d)[0],
            customer_updates(s, d)[1].selectExpr("*", "c_acctbal > 0 AS in_credit").drop("c_name"),
            ["c_custkey"],
            on_schema_change="append_new_columns",
        ),
        f"""{after} SELECT *, NULL::BOOLEAN AS in_credit FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM u)
            UNION ALL SELECT c_custkey, NULL AS c_name, c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 0 FROM u""",
    )

    def by_month(days: DataFrame) -> DataFrame:
        return days.withColumn("stored_month", F.expr("date(trunc(order_date, 'month'))"))

    cuts = ["1998-06-01", "2000-01-20", "2001-02-01", "2001-02-01", "2100-01-01"]
    register(
        "incremental_orders",
        lambda s, d: _in_steps(
            "fct_orders",
            ["order_id"],
            "order_month",
            cuts,
            _loaded_before,
            lambda i: core.fct_orders(i, AS_OF),
            lambda i, target, since: increments.orders_increment(i, AS_OF, target, loaded_since=since),
            keys_stay=False,
        )(s, d).drop("ordered_at"),
        ORACLES["fct_orders"],
    )
    def until(cut: str) -> dt.date:
        """The last whole day before a cut that the run knows."""
        return min(dt.date.fromisoformat(cut) - dt.timedelta(days=1), AS_OF)

    def store_days_in_steps(spark: SparkSession, folder: str) -> DataFrame:
        table = KeyedTable(spark, fresh_path(spark, "store_performance"), ["store_id", "order_date"], "stored_month", keys_stay=True)
        whole = replaced(sample_retail.retail_inputs(spark, folder), **_landed(spark, folder, line_ids=False))
        for cut in cuts:
            inputs = replaced(whole)
            _loaded_before(inputs, cut)
            if table.exists():
                since = dt.date.fromisoformat(table.mark())
                rows = increments.store_performance_increment(inputs, until(cut), table.read(), FIRST, loaded_since=since)
            else:
                rows = core.store_performance(inputs, until(cut), FIRST)
            table.upsert(by_month(rows), mark=cut)
        return table.read().drop("stored_month")

    register("incremental_store_performance", store_days_in_steps, ORACLES["store_performance"])
    register(
        "incremental_revenue_daily",
        _in_steps(
            "revenue_daily",
            ["revenue_date", "store_id"],
            "order_month",
            cuts,
            _loaded_before,
            lambda i: finance.revenue_daily(i, AS_OF),
            lambda i, target, since: increments.revenue_daily_increment(i, AS_OF, target, loaded_since=since),
        ),
        ORACLES["revenue_daily"],
    )
    register(
        "incremental_campaign_performance",
        _in_steps(
            "campaign_performance",
            ["campaign_id", "spend_date"],
            "spend_month",
            ["2000-03-10", "2001-02-01", "2100-01-01"],
            _loaded_before,
            lambda i: marketing.campaign_performance(i, AS_OF),
            lambda i, target, since: increments.campaign_performance_increment(i, AS_OF, target, loaded_since=since),
        ),
        ORACLES["campaign_performance"],
    )
    register(
        "incremental_channel_attribution",
        _in_steps(
            "channel_attribution",
            ["attributed_channel", "order_month"],
            "order_month",
            ["2024-01-20", "2024-01-25", "2100-01-01"],
            _loaded_before,
            lambda i: marketing.channel_attribution(i, AS_OF),
            lambda i, target, since: increments.channel_attribution_increment(i, AS_OF, target, loaded_since=since),
            make=sample_retail.web_inputs,
            whole_partitions=True,
        ),
        ORACLES["channel_attribution"],
    )

    def items_in_steps(spark: SparkSession, folder: str) -> DataFrame:
        orders = KeyedTable(spark, fresh_path(spark, "fct_orders"), ["order_id"], "order_month")
        items = KeyedTable(spark, fresh_path(spark, "fct_order_items"), ["order_item_id"], "order_month", sort_by=["order_id"], deal=_deals(spark, folder))
        whole = replaced(sample_retail.retail_inputs(spark, folder), **_landed(spark, folder))
        for run, cut in ((dt.date(2000, 1, 20), "2000-01-20"), (dt.date(2001, 2, 1), "2001-02-01"), (AS_OF, "2100-01-01")):
            inputs = replaced(whole)
            _loaded_before(inputs, cut)
            if orders.exists():
                since = dt.date.fromisoformat(orders.mark())
                orders.upsert(increments.orders_increment(inputs, run, orders.read(), loaded_since=since), mark=cut)
                changed = increments.order_items_increment(inputs, run, items.read(), orders.read(), by_order=True)
            else:
                orders.upsert(core.fct_orders(inputs, run), mark=cut)
                changed = increments.lines_of_orders(inputs, run, orders.read(), by_order=True)
            with _staying_by_order(spark):
                items.upsert(changed)
        return items.read()

    register("incremental_order_items", items_in_steps, ORACLES["fct_order_items"])
    stock = """, sold AS (SELECT product_id, store_id, order_date, sum(quantity) AS units FROM fct_order_items WHERE order_status = 'COMPLETED' GROUP BY 1, 2, 3),
        opening AS (SELECT product_id, store_id, sum(units) + product_id % 400 AS opening_units FROM sold GROUP BY 1, 2)"""
    register(
        "inventory_positions",
        lambda s, d: (lambda i: core.inventory_positions(i, AS_OF, _opening_stock(i)))(sample_retail.retail_inputs(s, d)),
        oracle.query(f"""{stock}
        SELECT product_id, store_id, order_date::VARCHAR AS snapshot_date, (lead(order_date) OVER w - 1)::VARCHAR AS valid_until,
               (opening_units - sum(units) OVER w)::BIGINT AS units_on_hand, units::BIGINT AS units_sold_today
        FROM sold JOIN opening USING (product_id, store_id) WINDOW w AS (PARTITION BY product_id, store_id ORDER BY order_date)"""),
    )
    register(
        "incremental_inventory",
        lambda s, d: _inventory_in_runs(s, d).drop("built_at"),
        oracle.query(f"""{stock},
        days AS (SELECT unnest(generate_series(DATE '2001-07-24', {oracle.AS_OF}, INTERVAL 1 DAY))::DATE AS d),
        earlier AS (SELECT product_id, store_id, sum(units) AS units FROM sold WHERE order_date < DATE '2001-07-24' GROUP BY 1, 2),
        grid AS (
          SELECT o.product_id, o.store_id, d, coalesce(s.units, 0) AS units,
                 o.opening_units - coalesce(e.units, 0) - sum(coalesce(s.units, 0)) OVER (PARTITION BY o.product_id, o.store_id ORDER BY d) AS level
          FROM opening o CROSS JOIN days LEFT JOIN earlier e USING (product_id, store_id)
          LEFT JOIN sold s ON s.product_id = o.product_id AND s.store_id = o.store_id AND s.order_date = d)
        SELECT g.product_id, p.product_name, p.category, p.cost_price::DOUBLE AS cost_price, g.store_id, st.store_name, st.store_type, st.region,
               d::VARCHAR AS snapshot_date, level::BIGINT AS units_on_hand, units::BIGINT AS units_sold_today,
               CASE WHEN st.store_type = 'physical' THEN level < 30 ELSE level < 200 END AS is_below_reorder_point
        FROM grid g JOIN products p USING (product_id) JOIN stores st USING (store_id) WHERE st.is_active"""),
    )
    register(
        "inventory_increment",
        _inventory_last_week,
        oracle.query(f"""{stock}
        SELECT *, CASE WHEN store_type = 'physical' THEN units_on_hand < 30 ELSE units_on_hand < 200 END AS is_below_reorder_point
        FROM (SELECT product_id, p.product_name, p.category, p.cost_price::DOUBLE AS cost_price, store_id, st.store_name, st.store_type,
                     st.region, d::VARCHAR AS snapshot_date,
                     (opening_units - coalesce(sum(units) FILTER (order_date <= d), 0))::BIGINT AS units_on_hand,
                     coalesce(sum(units) FILTER (order_date = d), 0)::BIGINT AS units_sold_today
              FROM opening JOIN products p USING (product_id) JOIN stores st USING (store_id) LEFT JOIN sold USING (product_id, store_id),
                   (SELECT unnest(generate_series(DATE '2001-07-27', {oracle.AS_OF}, INTERVAL 1 DAY))::DATE AS d)
              WHERE st.is_active GROUP BY product_id, p.product_name, p.category, p.cost_price, store_id, st.store_name, st.store_type, st.region, d, opening_units)"""),
    )
    register(
        "scd2_result",
        lambda s, d: _customer_history(s, d).drop("version_id"),
        oracle.query(f"{_SNAPSHOT_SQL} SELECT {_VERSION_COLUMNS} FROM versions"),
    )
    register(
        "scd2_as_of",
        lambda s, d: history.as_of(_customer_history(s, d), dt.date(2000, 6, 1)).drop("version_id"),
        oracle.query(f"{_SNAPSHOT_SQL} SELECT {_VERSION_COLUMNS} FROM versions WHERE valid_from <= DATE '2000-06-01'"
                     " AND (valid_to IS NULL OR valid_to > DATE '2000-06-01')"),
    )
    register(
        "scd2_as_of_join",
        lambda s, d: history.as_of_join(
            raw("raw_orders")(s, d).select("order_id", "customer_id", "order_date"),
            _customer_history(s, d),
            "customer_id",
            "order_date",
            ["customer_lifecycle_stage", "total_orders"],
        ),
        oracle.query(f"""{_SNAPSHOT_SQL} SELECT r.order_id, r.customer_id, r.order_date::VARCHAR AS order_date,
            v.customer_lifecycle_stage AS version_customer_lifecycle_stage, v.total_orders AS version_total_orders
            FROM raw_orders r LEFT JOIN versions v ON v.customer_id = r.customer_id AND v.valid_from <= r.order_date
             AND (v.valid_to IS NULL OR r.order_date < v.valid_to)"""),
    )

    def publish_clustered(spark: SparkSession, folder: str) -> DataFrame:
        table = PublishedTable(spark, fresh_path(spark, "dim_customers"))
        return table.publish(retail(core.dim_customers)(spark, folder), "v1", cluster_by=["customer_segment", "customer_id"])

    register("published_table", publish_clustered, ORACLES["dim_customers"])

    def publish_interleaved(spark: SparkSession, folder: str) -> DataFrame:
        """Orders laid out for filters by day and by customer, read by both."""
        table = PublishedTable(spark, fresh_path(spark, "fct_orders"))
        stored = table.publish(retail(core.fct_orders)(spark, folder), "v1", cluster_by=["order_date", "customer_id"], interleave=True)
        return stored.filter("customer_id BETWEEN 40 AND 90 OR order_date BETWEEN DATE'1999-05-01' AND DATE'1999-06-30'").drop("ordered_at")

    register(
        "published_interleaved",
        publish_interleaved,
        f"""SELECT * FROM ({ORACLES["fct_orders"]}) WHERE customer_id BETWEEN 40 AND 90 OR order_date BETWEEN '1999-05-01' AND '1999-06-30'""",
    )

    def items_of_bucketed_tables(spark: SparkSession, folder: str) -> DataFrame:
        inputs, count = sample_retail.retail_inputs(spark, folder), int(spark.conf.get("spark.sql.shuffle.partitions"))

        def store(name: str, *parts: DataFrame) -> DataFrame:
            path = fresh_path(spark, name)
            for number, rows in enumerate(parts):
                table = bucketed(rows, path.rpartition("/")[2].replace("-", "_"), path, "order_id", count, append=number > 0)
            return table

        lost = staging.stg_order_items(inputs, AS_OF).filter("order_id IS NULL")
        apart = enrich.order_items_enriched(inputs, AS_OF, lost.withColumn("product_copy", F.lit(1)), ["product_copy"])
        with _staying_by_order(spark):
            items = store("order_items_enriched", enrich.order_items_by_order(inputs, AS_OF), apart)
        # Orders sum the lines where these lie.
        lines = items.filter("product_copy = 1").withColumn("line_discount_amount", F.expr("round(line_gross_revenue - line_net_revenue, 2)"))
        orders = store("fct_orders", core.fct_orders(replaced(inputs, stg_order_items=lines), AS_OF))
        return core.fct_order_items(replaced(inputs, fct_orders=orders, order_items_enriched=items), AS_OF)

    register("bucketed_order_items", items_of_bucketed_tables, ORACLES["fct_order_items"])
    register(
        "stream_latest_purchase",
        _stream_orders,
        """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
           FROM events WHERE event_type = 'purchase') WHERE rn = 1""",
    )
    register("stream_last_touch", lambda s, d: _stream_credits(s, d)[2], ORACLES["last_touch"])
    register("stream_channel_attribution", lambda s, d: _stream_credits(s, d)[1].read(), ORACLES["channel_attribution"])
    register("stream_order_items", _stream_order_items, ORACLES["fct_order_items"])
    register(
        "stream_closed_days",
        _stream_closed_days,
        """SELECT event_id % 25 AS store_id, ts::DATE::VARCHAR AS day, count(*) AS orders, sum(value::DECIMAL(12,2))::DOUBLE AS revenue
           FROM events WHERE event_type = 'purchase'
             AND ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 3 DAY FROM events WHERE event_type = 'purchase') GROUP BY 1, 2""",
    )
    register(
        "stream_store_days",
        _stream_store_days,
        """SELECT event_id % 25 AS store_id, ts::DATE::VARCHAR AS day, count(*) AS orders, sum(value::DECIMAL(12,2))::DOUBLE AS revenue
           FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""",
    )


_register_pipelines()
_register_metrics()
_register_checks()
_register_shapes()
_register_diffs()
_register_maintenance()
