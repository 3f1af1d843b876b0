"""Retail inputs derived from the generic star-schema tables (orders, lineitem, customer, …).

Only projections, equi joins and one grouping per derived table; every rule is a function of
the row's own keys, so the tables keep the size and skew of what they come from.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.scalars import MONEY, cents, exprs, quoted, whole_ratio
from marketloom.sources.schemas import ALL

# Names given to derived codes, in code order.
STORE_CHANNELS = ["in-store", "online", "mobile"]
ACQUISITION_CHANNELS = ["organic", "paid_search", "paid_social", "referral"]
TRAFFIC_SOURCES = ["paid_search", "paid_social", "organic", "email", "direct", "affiliate", "referral"]
TOUCH_SOURCES = ["paid_search", "paid_social", "organic", "email", "direct"]
CAMPAIGN_CHANNELS = ["paid_search", "paid_social", "email", "affiliate"]
CAMPAIGN_TYPES = ["awareness", "conversion", "retention"]
PAYMENT_METHODS = ["credit_card", "debit_card", "paypal", "gift_card"]
RETURN_REASONS = ["defective", "wrong_size", "changed_mind"]
RESOLUTIONS = ["refund", "exchange"]


# Declared, so that planning a query reads no file footers.
SOURCES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCES[name]).parquet(f"{folder}/{name}.parquet")


def _name(names: list[str], code: str) -> str:
    return f"element_at(array({', '.join(map(quoted, names))}), int({code}) + 1)"


def _typed(df: DataFrame, name: str, **columns: str) -> DataFrame:
    """The input table ``name``: its declared columns, each from an expression over ``df``."""
    declared = T.StructType.fromDDL(ALL[name]).fields
    return df.selectExpr(*[f"cast({columns[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in declared])


def catalog_stores(t) -> DataFrame:
    n, r = t("nation"), t("region")
    return _typed(
        n.join(r, n.n_regionkey == r.r_regionkey, "left"),
        "catalog_stores",
        store_id="n_nationkey",
        store_name="'Store ' || n_name",
        store_type="CASE WHEN n_nationkey % 3 = 0 THEN 'physical' ELSE 'digital' END",
        channel=_name(STORE_CHANNELS, "n_nationkey % 3"),
        city="'City ' || n_nationkey",
        state="'ST' || (n_nationkey % 10)",
        region="r_name",
        opened_date="date_add(DATE'1990-01-01', n_nationkey * 30)",
        sq_footage="n_nationkey * 1000 + 500",
        district="'District ' || (n_nationkey % 4)",
        is_active="n_nationkey % 10 <> 9",
        manager_name="'Manager ' || n_nationkey",
    )


def catalog_products(t) -> DataFrame:
    return _typed(
        t("part"),
        "catalog_products",
        product_id="p_partkey",
        product_name="p_name",
        sku="'SKU-' || p_partkey",
        category="p_type",
        subcategory="p_type || '-' || (p_size % 5)",
        unit_price=f"cast(p_retailprice AS {MONEY})",
        cost_price=f"round(cast(p_retailprice AS {MONEY}) * 0.60, 2)",
        margin_pct="40",
        brand="p_brand",
        is_active="p_partkey % 20 <> 0",
        launch_date="date_add(DATE'1994-01-01', int(p_partkey % 365))",
        weight_lbs="p_size / 4D",
        is_featured="p_partkey % 7 = 0",
    )


def raw_customers(t) -> DataFrame:
    c = t("customer")
    first = t("orders").groupBy("o_custkey").agg(F.expr("min(date(o_orderdate)) AS first_day"))
    acquired = "date_sub(first_day, int(c_custkey % 90))"
    return _typed(
        c.join(first, c.c_custkey == first.o_custkey, "left"),
        "raw_customers",
        customer_id="c_custkey",
        first_name="'Customer'",
        last_name="split_part(c_name, '#', 2)",
        email="'Customer.' || c_custkey || '@Example.com'",
        city="'City ' || c_nationkey",
        state="'ST' || (c_nationkey % 10)",
        customer_segment="c_mktsegment",
        acquisition_channel=_name(ACQUISITION_CHANNELS, "c_custkey % 4"),
        acquisition_date=acquired,
        age="c_custkey % 60 + 18",
        gender="CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END",
        is_email_subscribed="c_custkey % 2 = 0",
        is_sms_subscribed="c_custkey % 3 = 0",
        created_at=acquired,
        updated_at=acquired,
    )


def raw_orders(t) -> DataFrame:
    o, c = t("orders"), t("customer").select("c_custkey", "c_nationkey")
    campaigns = t("supplier").agg(F.expr("count(*)")).scalar()
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").withColumn("campaigns", campaigns)
    return _typed(
        joined,
        "raw_orders",
        order_id="o_orderkey",
        order_date="date(o_orderdate)",
        customer_id="o_custkey",
        store_id="c_nationkey",
        status="""CASE WHEN o_orderstatus <> 'P' THEN 'completed'
                       WHEN o_orderkey % 2 = 0 THEN 'Returned' ELSE 'CANCELLED' END""",
        discount_amount=f"""CASE WHEN o_orderkey % 5 = 1 THEN NULL
                                 WHEN o_orderkey % 5 = 0 THEN round(cast(o_totalprice AS {MONEY}) * 0.01, 2) ELSE 0 END""",
        payment_method=_name(PAYMENT_METHODS, "o_orderkey % 4"),
        campaign_id="CASE WHEN o_orderkey % 100 < 32 THEN o_orderkey % campaigns END",
        traffic_source=_name(TRAFFIC_SOURCES, "o_orderkey % 7"),
        item_count="o_orderkey % 5 + 1",
        ordered_at="o_orderdate",
        _loaded_at="date_add(date(o_orderdate), int(o_orderkey % 4))",
    )


def _priced(lines: DataFrame) -> DataFrame:
    gross = f"cast(l_extendedprice AS {MONEY})"
    return lines.selectExpr("*", f"{gross} AS gross", f"cast(round({gross} * cast(l_discount AS decimal(4,2)), 2) AS {MONEY}) AS off")


def raw_order_items(t) -> DataFrame:
    """Line numbers repeat inside an order, so copies are counted per (order, line number). The rows are numbered order by
    order and not by line number at once: joins and sums by order then find them dealt by order already. Columns that the result does not have break no ties: lines
    equal in all others are equal either way."""
    place = """row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
               l_quantity, l_extendedprice, l_discount)"""
    copy = "place - min(place) OVER (PARTITION BY l_orderkey, l_linenumber) + 1"
    return _typed(
        _priced(t("lineitem").selectExpr("*", f"{place} AS place").selectExpr("*", f"{copy} AS copy")),
        "raw_order_items",
        # Beyond these bounds ids would repeat, so that is an error.
        order_item_id="""if(l_linenumber BETWEEN 0 AND 7 AND copy < 1000000, (l_orderkey * 8 + l_linenumber) * 1000000 + copy,
                           bigint(raise_error('line or copy number beyond the range of order_item_id')))""",
        order_id="l_orderkey",
        product_id="l_partkey",
        quantity="l_quantity",
        unit_price_at_purchase=whole_ratio(cents("gross"), "bigint(l_quantity) * 100", 1, 2),
        line_gross_revenue="gross",
        line_net_revenue="gross - off",
        line_discount="off",
        _loaded_at="l_shipdate",
    )


def raw_returns(t) -> DataFrame:
    o, c = t("orders"), t("customer").select("c_custkey", "c_nationkey")
    back = o.filter("o_orderstatus = 'P' AND o_orderkey % 2 = 0")
    return _typed(
        back.join(c, back.o_custkey == c.c_custkey, "left"),
        "raw_returns",
        return_id="o_orderkey * 10 + 1",
        order_id="o_orderkey",
        customer_id="o_custkey",
        store_id="c_nationkey",
        order_date="date(o_orderdate)",
        return_date="date_add(date(o_orderdate), int(o_orderkey % 19 + 3))",
        return_reason=_name(RETURN_REASONS, "o_orderkey % 3"),
        resolution_type=_name(RESOLUTIONS, "o_orderkey % 2"),
        refund_amount=f"round(cast(o_totalprice AS {MONEY}) * 0.50, 2)",
        return_status="CASE WHEN o_orderkey % 100 < 85 THEN 'approved' ELSE 'denied' END",
        _loaded_at="date_add(date(o_orderdate), int(o_orderkey % 19 + 4))",
    )


def raw_ad_spend(t) -> DataFrame:
    tax = f"round(cast(l_extendedprice AS {MONEY}) * cast(l_tax AS decimal(4,2)), 2)"
    daily = (
        t("lineitem")
        .groupBy(*exprs("l_suppkey", "date(l_shipdate) AS day"))
        .agg(
            *exprs(
                f"sum({tax}) AS spend",
                "sum(CASE WHEN l_returnflag <> 'N' THEN bigint(l_quantity) * 1000 ELSE 0 END) AS impressions",
                "sum(CASE WHEN l_returnflag = 'R' THEN bigint(l_quantity) ELSE 0 END) AS clicks",
                "count(DISTINCT l_orderkey) AS orders",
            )
        )
    )
    return _typed(
        daily,
        "raw_ad_spend",
        spend_id="l_suppkey * 100000 + datediff(day, DATE'1990-01-01')",
        campaign_id="l_suppkey",
        campaign_name="'Campaign ' || l_suppkey",
        channel=_name(CAMPAIGN_CHANNELS, "l_suppkey % 4"),
        campaign_type=_name(CAMPAIGN_TYPES, "l_suppkey % 3"),
        spend_date="day",
        spend_usd="spend",
        impressions="impressions",
        clicks="clicks",
        attributed_orders="orders",
        _loaded_at="date_add(day, 1)",
    )


def catalog_campaigns(t) -> DataFrame:
    start = "date_add(DATE'1995-01-01', int(s_suppkey % 700))"
    return _typed(
        t("supplier"),
        "catalog_campaigns",
        campaign_id="s_suppkey",
        campaign_name="'Campaign ' || s_suppkey",
        channel=_name(CAMPAIGN_CHANNELS, "s_suppkey % 4"),
        campaign_type=_name(CAMPAIGN_TYPES, "s_suppkey % 3"),
        start_date=start,
        end_date=f"date_add({start}, int(s_suppkey % 60 + 1))",
        budget_usd="abs(floor(s_acctbal))",
        target_segment="'BUILDING'",
        utm_source=_name(CAMPAIGN_CHANNELS, "s_suppkey % 4"),
        utm_medium="'cpc'",
        utm_campaign="'c' || s_suppkey",
        is_active="s_suppkey % 5 <> 0",
    )


def catalog_promotions(t) -> DataFrame:
    start = "date_add(DATE'1996-01-01', int(p_partkey % 900))"
    return _typed(
        t("part").filter("p_size < 10"),
        "catalog_promotions",
        promotion_id="p_partkey",
        promotion_code="'SAVE' || p_partkey",
        promotion_name="p_brand || ' week'",
        discount_type="if(p_size % 2 = 0, 'percentage', 'fixed_amount')",
        discount_value="p_size * 2.5D",
        min_order_amount="floor(p_retailprice)",
        start_date=start,
        end_date=f"date_add({start}, p_size + 6)",
        channel=_name(STORE_CHANNELS, "p_partkey % 3"),
        is_stackable="p_partkey % 4 = 0",
        max_redemptions="p_size * 1000",
        is_active="p_partkey % 6 <> 0",
    )


def catalog_payment_methods(t) -> DataFrame:
    """A method for each priority and state in which orders are placed."""
    used = t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.expr("min(o_orderkey) AS number"))
    return _typed(
        used,
        "catalog_payment_methods",
        payment_method_id="number",
        payment_method="lower(o_orderpriority || '-' || o_orderstatus)",
        payment_category="if(o_orderstatus = 'F', 'card', 'wallet')",
        processor="'processor ' || o_orderstatus",
        processing_fee_pct="number % 5 + 0.5D",
        supports_refund="o_orderstatus <> 'P'",
        supports_partial_refund="o_orderstatus = 'F'",
        is_active="number % 9 <> 0",
    )


def _events(t) -> DataFrame:
    return t("events").selectExpr(
        "*",
        """CASE event_type WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart'
                WHEN 'signup' THEN 'checkout_started' WHEN 'purchase' THEN 'purchase_completed'
                ELSE event_type END AS kind""",
        _name(TOUCH_SOURCES, "int(get_json_object(props, '$.k')) % 5") + " AS source",
        "CASE WHEN event_id % 7 <> 0 THEN event_id % 50 END AS product",
        f"cast(value AS {MONEY}) AS price",
    )


def raw_events(t) -> DataFrame:
    return _typed(
        _events(t),
        "raw_events",
        event_id="event_id",
        customer_id="user_id",
        event_date="date(ts)",
        event_type="kind",
        traffic_source="source",
        device_type="""CASE WHEN event_id % 20 < 11 THEN 'mobile' WHEN event_id % 20 < 16 THEN 'desktop' ELSE 'tablet' END""",
        product_id="product",
        session_id="'s' || lpad(string(event_id DIV 4), 12, '0')",
        _loaded_at="ts",
    )


def web_orders(t) -> DataFrame:
    """Purchases of the event stream as orders (their days overlap the touch events)."""
    return _typed(
        _events(t).filter("event_type = 'purchase'"),
        "raw_orders",
        order_id="event_id",
        order_date="date(ts)",
        customer_id="user_id",
        store_id="event_id % 25",
        status="'completed'",
        discount_amount="0",
        payment_method="'credit_card'",
        campaign_id="NULL",
        traffic_source="source",
        item_count="1",
        ordered_at="ts",
        _loaded_at="ts",
    )


def web_order_items(t) -> DataFrame:
    off = f"cast(round(price * 0.05, 2) AS {MONEY})"
    return _typed(
        _events(t).filter("event_type = 'purchase'"),
        "raw_order_items",
        order_item_id="event_id",
        order_id="event_id",
        product_id="coalesce(product, 0)",
        quantity="1",
        unit_price_at_purchase="price",
        line_gross_revenue="price",
        line_net_revenue=f"price - {off}",
        line_discount=off,
        _loaded_at="ts",
    )


def located(df: DataFrame, key: str) -> DataFrame:
    """Keys with a place on the globe that follows from the key; every 17th one is at a place of its neighbour."""
    own = f"({key} - CASE WHEN {key} % 17 = 0 THEN 1 ELSE 0 END)"
    return df.selectExpr(key, f"({own} * 7919 % 170000 - 85000) / 1000D AS lat", f"({own} * 104729 % 360000 - 180000) / 1000D AS lon")


class LazyInputs(dict):
    """Inputs that are read and planned when first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        super().__init__()
        self._makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._makers[name]()
        return self[name]


RETAIL = {
    f.__name__: f
    for f in (
        catalog_stores,
        catalog_products,
        catalog_campaigns,
        catalog_promotions,
        catalog_payment_methods,
        raw_customers,
        raw_orders,
        raw_order_items,
        raw_returns,
        raw_ad_spend,
        raw_events,
    )
}


def _inputs(spark: SparkSession, folder: str, tables: dict[str, Callable]) -> LazyInputs:
    @cache
    def t(name: str) -> DataFrame:
        return load(spark, folder, name)

    return LazyInputs({name: partial(make, t) for name, make in tables.items()})


def retail_inputs(spark: SparkSession, folder: str) -> LazyInputs:
    return _inputs(spark, folder, RETAIL)


def web_inputs(spark: SparkSession, folder: str) -> LazyInputs:
    """As ``retail_inputs``, with orders and lines taken from the purchases of the event stream."""
    return _inputs(
        spark,
        folder,
        {
            **RETAIL,
            "raw_orders": web_orders,
            "raw_order_items": web_order_items,
            "raw_returns": lambda t: raw_returns(t).filter("false"),
        },
    )
