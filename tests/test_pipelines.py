"""Hand-computed results for a small retail data set with the awkward cases."""

import datetime as dt
from decimal import Decimal as D

import pytest

from marketloom.plans import core, enrich, finance, marketing, staging
from marketloom.plans.base import use
from marketloom.sources.schemas import ALL
from tests.conftest import rows

AS_OF = dt.date(2026, 8, 1)
T = dt.datetime


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def inputs(spark):
    def make(name, *data):
        return spark.createDataFrame(list(data), ALL[name])

    def order(i, date, customer, store, status, discount=None, campaign=None, source="email"):
        loaded = T.combine(day(date), dt.time(5))
        return (i, day(date), customer, store, status, discount, "card", campaign, source, 1, loaded, loaded)

    def line(i, order_id, product, quantity, price, gross, net):
        return (i, order_id, product, quantity, D(price), D(gross), D(net), D(gross) - D(net), T(2026, 6, 1))

    def back(i, order_id, date, refund, status):
        return (i, order_id, 1, 1, day("2026-06-10"), day(date), "defective", "refund", D(refund), status, T(2026, 6, 30))

    def customer(i, first, last, gender, acquired):
        at = T.combine(day(acquired), dt.time())
        return (i, first, last, f"{first}@X.COM", "c", "s", "VIP", "organic", day(acquired), 30, gender, True, False, at, at)

    return {
        "raw_customers": make(
            "raw_customers",
            customer(1, "Ann", "Lee", "F", "2026-06-20"),  # ordered before the acquisition date
            customer(2, "Bob", "Ray", "M", "2026-01-31"),
            customer(3, "Cy", "Fox", None, "2026-05-05"),  # no orders
        ),
        "raw_orders": make(
            "raw_orders",
            order(10, "2026-06-10", 1, 1, "Completed", D("5.00"), 7),
            order(11, "2026-06-10", 1, 1, "returned", None, source="direct"),  # two approved returns
            order(12, "2026-06-10", 2, 99, "CANCELLED", D("0.00")),  # unknown store, no lines
            order(13, "2026-02-01", 2, 1, "completed", source="direct"),
            order(14, "2026-06-11", 2, 2, "returned"),  # denied return
            order(15, "2026-06-10", 2, 1, "completed", source="direct"),
        ),
        "raw_order_items": make(
            "raw_order_items",
            line(1, 10, 100, 2, "10.00", "20.00", "18.00"),
            line(2, 10, 101, 1, "5.00", "5.00", "5.00"),
            line(3, 11, 100, 1, "10.00", "10.00", "10.00"),
            line(4, 13, 101, 4, "5.00", "20.00", "20.00"),
            line(5, 14, 100, 3, "0.00", "0.00", "0.00"),
            line(6, 15, 102, 1, "25.00", "25.00", "25.00"),  # unknown product
        ),
        "raw_returns": make(
            "raw_returns",
            back(1, 11, "2026-06-15", "6.00", "approved"),
            back(2, 11, "2026-06-20", "9.00", "APPROVED"),
            back(3, 14, "2026-06-21", "1.00", "denied"),
        ),
        "catalog_products": make(
            "catalog_products",
            (100, "Tea", "T1", "drinks", "tea", D("10.00"), D("4.00"), 60.0, "b", True, day("2020-01-01"), 1.0, True),
            (101, "Bun", "B1", "bakery", "bun", D("5.00"), D("4.00"), 20.0, "b", True, day("2020-01-01"), 1.0, False),
        ),
        "catalog_stores": make(
            "catalog_stores",
            (1, "Main", "physical", "in-store", "c", "s", "North", day("2020-01-01"), 10, "d", True, "m"),
            (2, "Web", "digital", "online", "c", "s", "South", day("2020-01-01"), 10, "d", True, "m"),
            (3, "Shut", "physical", "in-store", "c", "s", "North", day("2020-01-01"), 10, "d", False, "m"),
        ),
        "raw_ad_spend": make(
            "raw_ad_spend",
            (1, 7, "C7", "email", "brand", day("2026-06-10"), D("9.20"), 1000, 50, 2, T(2026, 6, 11)),
            (2, 7, "C7", "email", "brand", day("2026-06-12"), D("0.00"), 0, 0, 0, T(2026, 6, 13)),
        ),
    }


def test_orders(inputs):
    got = rows(
        core.fct_orders(inputs, AS_OF),
        "order_id", "order_status", "store_name", "has_discount", "order_level_discount", "net_revenue", "total_units",
        "distinct_products", "estimated_tax", "refund_amount", "return_date", "realized_revenue",
    )
    assert got == [
        (10, "COMPLETED", "Main", True, D("5.00"), D("23.00"), 3, 2, D("1.96"), None, None, D("23.00")),
        (11, "RETURNED", "Main", None, D("0.00"), D("10.00"), 1, 1, D("0.00"), D("15.00"), day("2026-06-20"), D("0.00")),
        (12, "CANCELLED", None, False, D("0.00"), D("0.00"), 0, 0, D("0.00"), None, None, D("0.00")),
        (13, "COMPLETED", "Main", None, D("0.00"), D("20.00"), 4, 1, D("1.70"), None, None, D("20.00")),
        (14, "RETURNED", "Web", None, D("0.00"), D("0.00"), 3, 1, D("0.00"), None, None, D("0.00")),
        (15, "COMPLETED", "Main", None, D("0.00"), D("25.00"), 1, 1, D("2.13"), None, None, D("25.00")),
    ]


def test_returns_approval_reads_either_case(inputs):
    assert rows(staging.stg_returns(inputs, AS_OF), "return_id", "is_approved", "days_to_return") == [
        (1, True, 5), (2, True, 10), (3, False, 11)
    ]
    literal = staging.stg_returns(inputs, AS_OF, compat=True)
    assert rows(literal, "return_id", "is_approved") == [(1, False), (2, True), (3, False)]


def test_lines(inputs):
    got = rows(
        core.fct_order_items(inputs, AS_OF),
        "order_item_id", "order_status", "category", "discount_pct", "unit_margin", "line_margin", "line_margin_pct",
    )
    assert got == [
        (1, "COMPLETED", "drinks", 10.0, D("6.00"), D("12.00"), 60.0),
        (2, "COMPLETED", "bakery", 0.0, D("1.00"), D("1.00"), 20.0),
        (3, "RETURNED", "drinks", 0.0, D("6.00"), D("6.00"), 60.0),
        (4, "COMPLETED", "bakery", 0.0, D("1.00"), D("4.00"), 20.0),
        (5, "RETURNED", "drinks", 0.0, D("-4.00"), D("-12.00"), 0.0),
        (6, "COMPLETED", None, 0.0, None, None, None),
    ]


def test_customers(inputs):
    got = rows(
        core.dim_customers(inputs, AS_OF),
        "customer_id", "full_name", "email", "gender", "acquisition_quarter", "days_since_acquisition", "total_orders",
        "completed_orders", "lifetime_net_revenue", "avg_order_value", "distinct_channels_used", "most_common_channel",
        "customer_lifecycle_stage", "customer_value_tier",
    )
    assert got == [
        (1, "Ann Lee", "ann@x.com", "Female", day("2026-04-01"), 42, 2, 1, D("23.00"), 25.0, 2, "direct", "active", "low_value"),
        (2, "Bob Ray", "bob@x.com", "Male", day("2026-01-01"), 182, 4, 2, D("45.00"), 22.5, 2, "direct", "active", "low_value"),
        (3, "Cy Fox", "cy@x.com", "Unknown", day("2026-04-01"), 88, 0, 0, D("0.00"), None, 0, None, "never_purchased", "no_purchases"),
    ]


def test_lifecycle_edges(inputs):
    last = day("2026-06-11")
    for age, stage in ((90, "active"), (91, "at_risk"), (180, "at_risk"), (181, "churned")):
        got = enrich.customers_with_orders(inputs, last + dt.timedelta(days=age)).filter("customer_id = 2")
        assert got.first().customer_lifecycle_stage == stage


def test_revenue_daily_and_margin(inputs):
    got = rows(
        finance.revenue_daily(inputs, AS_OF),
        "revenue_date", "store_id", "total_orders", "net_revenue", "total_refunds", "unique_customers", "total_cogs",
        "gross_margin_pct",
    )
    assert got == [
        (day("2026-02-01"), 1, 1, D("20.00"), D("0.00"), 1, D("16.00"), 20.0),
        (day("2026-06-10"), 1, 3, D("48.00"), D("15.00"), 2, D("12.00"), 75.0),
        (day("2026-06-10"), 99, 1, D("0.00"), D("0.00"), 1, D("0.00"), None),
        (day("2026-06-11"), 2, 1, D("0.00"), D("0.00"), 1, D("0.00"), None),
    ]
    unparenthesised = finance.revenue_daily(inputs, AS_OF, compat=True).filter("net_revenue > 0")
    assert rows(unparenthesised, "revenue_date", "gross_margin_pct") == [
        (day("2026-02-01"), 20 - 80.0), (day("2026-06-10"), 48 - 25.0)
    ]


def test_revenue_daily_from_stored_tables(inputs):
    stored = {**inputs, "fct_orders": core.fct_orders(inputs, AS_OF), "fct_order_items": core.fct_order_items(inputs, AS_OF)}
    assert rows(finance.revenue_daily(stored, AS_OF)) == rows(finance.revenue_daily(inputs, AS_OF))


def test_monthly_lag_stays_in_its_series(spark):
    def d(month, region, net):
        return (day(month), 1, day(month).year, "online", region, 1, 1, 0, D(net), D(net), D(net), D("0"), D("0"), D("1.00"), D("0"), 1, 5.0)

    daily = spark.createDataFrame(
        [d("2026-01-01", "N", "10.00"), d("2026-01-01", "S", "40.00"), d("2026-02-01", "N", "20.00"), d("2026-04-01", "S", "30.00")],
        "order_month date, order_quarter int, order_year int, store_channel string, store_region string, total_orders long,"
        "completed_orders long, returned_orders long, gross_revenue decimal(12,2), net_revenue decimal(12,2),"
        "realized_revenue decimal(12,2), total_discounts decimal(12,2), total_refunds decimal(12,2), total_cogs decimal(12,2),"
        "estimated_tax decimal(12,2), unique_customers long, avg_order_value double",
    )
    orders = spark.createDataFrame([], "order_month date, store_channel string, store_region string, customer_id long")
    inputs = {"revenue_daily": daily, "fct_orders": orders}
    columns = "store_region", "revenue_month", "prior_month_net_revenue", "mom_revenue_growth_pct", "gross_margin_pct"
    assert rows(finance.revenue_monthly(inputs, AS_OF), *columns) == [
        ("N", day("2026-01-01"), None, None, 90.0),
        ("N", day("2026-02-01"), D("10.00"), 100.0, 95.0),
        ("S", day("2026-01-01"), None, None, 97.5),
        ("S", day("2026-04-01"), D("40.00"), -25.0, 96.67),
    ]
    mixed = finance.revenue_monthly(inputs, AS_OF, compat=True).filter("revenue_month = DATE'2026-01-01'")
    assert rows(mixed, "store_region", "prior_month_net_revenue") == [("N", None), ("S", D("10.00"))]


def test_refunds_ltv_and_cohorts(inputs):
    got = rows(finance.refunds_enriched(inputs, AS_OF), "return_id", "order_id", "days_to_return", "refund_as_pct_of_order")
    assert got == [(1, 11, 10, 150.0)]
    ltv = rows(finance.customer_ltv(inputs, AS_OF), "customer_id", "total_refunds", "net_ltv", "predicted_12m_ltv")
    assert ltv == [(1, D("15.00"), D("8.00"), 434.52), (2, D("0.00"), D("45.00"), 180.49), (3, D("0.00"), D("0.00"), 0.0)]
    cohorts = rows(finance.customer_cohorts(inputs, AS_OF), "customer_id", "activity_month", "months_since_acquisition")
    assert cohorts == [(1, day("2026-06-01"), 0), (2, day("2026-02-01"), 1), (2, day("2026-06-01"), 5), (3, None, None)]
    curve = rows(
        finance.cohort_analysis(inputs, AS_OF),
        "cohort_month", "months_since_acquisition", "cohort_size", "retention_rate_pct", "cumulative_cohort_revenue",
    )
    assert curve == [
        (day("2026-01-01"), 1, 1, 100.0, D("20.00")),
        (day("2026-01-01"), 5, 1, 100.0, D("45.00")),
        (day("2026-06-01"), 0, 1, 100.0, D("23.00")),
    ]
    assert finance.cohort_analysis(inputs, AS_OF, since=day("2026-06-01")).count() == 1


def test_store_days_without_orders_and_ties(inputs, spark):
    got = rows(
        core.store_performance(inputs, AS_OF, day("2026-06-10"), day("2026-06-11")),
        "store_id", "order_date", "total_orders", "unique_customers", "top_category", "average_order_value",
        "return_rate_pct", "performance_tier",
    )
    # Store 3 is not active; on the 10th drinks (20.00) lead, the unknown category (25.00) is NULL.
    assert got == [
        (1, day("2026-06-10"), 3, 2, None, 25.0, pytest.approx(100 / 3), "D"),
        (1, day("2026-06-11"), 0, 0, None, 0.0, 0.0, "D"),
        (2, day("2026-06-10"), 0, 0, None, 0.0, 0.0, "D"),
        (2, day("2026-06-11"), 1, 1, None, 0.0, 100.0, "D"),
    ]
    capped = core.store_performance(inputs, day("2026-06-10"), day("2026-06-09"), day("2027-01-01"))
    assert capped.count() == 4
    tie = {**inputs, "fct_order_items": spark.createDataFrame(
        [(1, day("2026-06-10"), "COMPLETED", c, D("5.00")) for c in ("b", "a", "c")],
        "store_id long, order_date date, order_status string, category string, line_gross_revenue decimal(12,2)",
    )}
    assert core.store_performance(tie, AS_OF, day("2026-06-10"), day("2026-06-10")).filter("store_id = 1").first().top_category == "a"


def test_campaigns(inputs):
    got = rows(
        marketing.campaign_performance(inputs, AS_OF),
        "spend_date", "click_through_rate_pct", "cost_per_click", "matched_orders", "roas", "roas_tier",
    )
    assert got == [
        (day("2026-06-10"), 5.0, 0.18, 1, 2.5, "efficient"),
        (day("2026-06-12"), None, None, 0, None, "underperforming"),
    ]
    platform = rows(staging.stg_platform_ad_spend(inputs, AS_OF), "click_through_rate_pct", "cost_per_click", "cost_per_acquisition")
    assert platform == [(0.0, None, None), (5.0, 0.184, 4.6)]
    assert rows(staging.stg_campaigns(inputs, AS_OF), "campaign_id", "start_date", "end_date", "budget_usd") == [
        (7, day("2026-06-10"), day("2026-06-12"), D("9.20"))
    ]


def test_last_touch_window(inputs, spark):
    touches = [
        # order 10 (customer 1, 10 June): exactly 30 days before counts
        (1, 1, "2026-05-11", "product_view", "email", "mobile", "s1"),
        # order 15 (customer 2, 10 June): 31 days before does not, and a direct touch never does
        (2, 2, "2026-05-10", "product_view", "organic", "mobile", "s2"),
        (3, 2, "2026-06-09", "product_view", "direct", "mobile", "s9"),
        # order 13 (customer 2, 1 February): two touches on one day, the larger session wins
        (4, 2, "2026-02-01", "add_to_cart", "paid_search", "tablet", "s3"),
        (5, 2, "2026-02-01", "add_to_cart", "paid_social", "desktop", "s4"),
        (6, 2, "2026-02-01", "page_view", "affiliate", "desktop", "s5"),
    ]
    events = spark.createDataFrame(
        [(i, c, day(d), kind, source, device, None, session, T(2026, 6, 1)) for i, c, d, kind, source, device, session in touches],
        ALL["raw_events"],
    )
    given = {**inputs, "raw_events": events}
    assert rows(marketing.attribution_touchpoints(given, AS_OF), "order_id", "attributed_channel", "touchpoint_date", "device_type") == [
        (10, "email", day("2026-05-11"), "mobile"),
        (13, "paid_social", day("2026-02-01"), "desktop"),
    ]
    assert rows(
        marketing.channel_attribution(given, AS_OF), "attributed_channel", "order_month", "attributed_orders", "mobile_revenue_pct"
    ) == [("email", day("2026-06-01"), 1, 100.0), ("paid_social", day("2026-02-01"), 1, 0.0)]


def test_calendar(spark):
    dates = core.dim_dates(spark)
    assert dates.count() == 2191
    assert dates.agg({"date_day": "max"}).first()[0] == day("2027-12-31")
    assert core.dim_dates(spark, compat=True).agg({"date_day": "max"}).first()[0] == day("2028-01-01")
    fridays = ["2022-11-25", "2023-11-24", "2024-11-29", "2025-11-28", "2026-11-27", "2027-11-26"]
    assert rows(dates.filter("is_black_friday"), "date_day") == [(day(d),) for d in fridays]
    mondays = ["2022-11-28", "2023-11-27", "2024-12-02", "2025-12-01", "2026-11-30", "2027-11-29"]
    assert rows(dates.filter("is_cyber_monday"), "date_day") == [(day(d),) for d in mondays]
    older = core.dim_dates(spark, compat=True)
    assert older.filter("is_black_friday AND date_day = DATE'2026-11-28'").count() == 1
    assert older.filter("is_cyber_monday AND month_num = 12 AND day_of_month = 1").count() == 6
    picked = dates.filter("date_day IN (DATE'2026-01-31', DATE'2026-02-01', DATE'2026-05-01')")
    assert rows(picked, "date_day", "fiscal_year", "fiscal_quarter", "fiscal_month", "day_of_week_num", "season") == [
        (day("2026-01-31"), 2025, 4, 12, 6, "Winter"),
        (day("2026-02-01"), 2026, 1, 1, 0, "Winter"),
        (day("2026-05-01"), 2026, 2, 4, 5, "Spring"),
    ]


def test_fiscal_calendar(spark):
    fiscal = finance.dim_fiscal_calendar(spark, AS_OF)
    assert fiscal.count() == 1095
    one = fiscal.filter("date_day = DATE'2026-01-15'").first()
    assert (one.fiscal_period_label, one.fiscal_quarter_label) == ("FY2025-P12", "FY2025-Q4")
    assert (one.fiscal_period_start, one.fiscal_year_start) == (day("2026-01-01"), day("2025-02-01"))
    assert fiscal.filter("is_current_fiscal_year").count() == 365
    assert rows(fiscal.filter("is_current_fiscal_quarter").selectExpr("min(date_day)", "max(date_day)")) == [
        (day("2026-08-01"), day("2026-10-31"))
    ]
    days = core.dim_dates(spark, day("2026-01-01"), day("2026-12-31"))
    older = finance.fiscal_calendar(days, AS_OF, compat=True)
    assert rows(older.filter("calendar_month IN (1, 7)"), "calendar_month", "fiscal_period_start")[::31] == [
        (1, day("2026-11-01")), (7, day("2026-02-01"))
    ]


def test_small_dimensions(spark):
    promotions = spark.createDataFrame(
        [(1, "P", "Promo", "percent", 10.0, 0.0, day("2026-01-01"), day("2026-02-01"), "online", True, 100, True)],
        ALL["catalog_promotions"],
    )
    methods = spark.createDataFrame([(1, "card", "card", "x", 2.9, True, True, True)], ALL["catalog_payment_methods"])
    inputs = {"catalog_promotions": promotions, "catalog_payment_methods": methods}
    assert core.dim_promotions(inputs, AS_OF).columns[-1] == "built_at"
    assert core.dim_payment_methods(inputs, AS_OF).first().processing_fee_pct == 2.9


def test_stored_tables_are_used(inputs):
    assert use({"fct_orders": inputs["raw_orders"]}, core.fct_orders, AS_OF) is inputs["raw_orders"]


def test_inventory(inputs, spark):
    opening = spark.createDataFrame([(100, 1, 31), (101, 1, 33), (100, 2, 150)], "product_id long, store_id long, opening_units long")
    daily = core.inventory_daily(inputs, AS_OF, opening, day("2026-06-09"), day("2026-06-11"))
    got = rows(daily, "product_id", "store_id", "snapshot_date", "units_on_hand", "units_sold_today", "is_below_reorder_point")
    assert got == [
        (100, 1, day("2026-06-09"), 31, 0, False),
        (100, 1, day("2026-06-10"), 29, 2, True),
        (100, 1, day("2026-06-11"), 29, 0, True),
        (100, 2, day("2026-06-09"), 150, 0, True),
        (100, 2, day("2026-06-10"), 150, 0, True),
        (100, 2, day("2026-06-11"), 150, 0, True),
        (101, 1, day("2026-06-09"), 29, 0, True),
        (101, 1, day("2026-06-10"), 28, 1, True),
        (101, 1, day("2026-06-11"), 28, 0, True),
    ]
    positions = rows(core.inventory_positions(inputs, AS_OF, opening), "product_id", "snapshot_date", "valid_until", "units_on_hand")
    assert positions == [
        (100, day("2026-06-10"), None, 29),
        (101, day("2026-02-01"), day("2026-06-09"), 29),
        (101, day("2026-06-10"), None, 28),
    ]
