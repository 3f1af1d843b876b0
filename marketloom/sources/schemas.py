"""Declared schemas of the input tables."""

from __future__ import annotations

# Raw tables: large, growing, loaded from CSV or Parquet.
RAW = {
    "raw_customers": (
        "customer_id bigint, first_name string, last_name string, email string, city string, "
        "state string, customer_segment string, acquisition_channel string, acquisition_date date, "
        "age int, gender string, is_email_subscribed boolean, is_sms_subscribed boolean, "
        "created_at timestamp, updated_at timestamp"
    ),
    "raw_orders": (
        "order_id bigint, order_date date, customer_id bigint, store_id bigint, status string, "
        "discount_amount decimal(12,2), payment_method string, campaign_id int, "
        "traffic_source string, item_count int, ordered_at timestamp, _loaded_at timestamp"
    ),
    "raw_order_items": (
        "order_item_id bigint, order_id bigint, product_id bigint, quantity int, "
        "unit_price_at_purchase decimal(12,2), line_gross_revenue decimal(12,2), "
        "line_net_revenue decimal(12,2), line_discount decimal(12,2), _loaded_at timestamp"
    ),
    "raw_returns": (
        "return_id bigint, order_id bigint, customer_id bigint, store_id bigint, order_date date, "
        "return_date date, return_reason string, resolution_type string, "
        "refund_amount decimal(12,2), return_status string, _loaded_at timestamp"
    ),
    "raw_ad_spend": (
        "spend_id bigint, campaign_id int, campaign_name string, channel string, "
        "campaign_type string, spend_date date, spend_usd decimal(12,2), impressions bigint, "
        "clicks bigint, attributed_orders bigint, _loaded_at timestamp"
    ),
    "raw_events": (
        "event_id bigint, customer_id bigint, event_date date, event_type string, "
        "traffic_source string, device_type string, product_id bigint, session_id string, "
        "_loaded_at timestamp"
    ),
}

# Catalogues: maintained by hand as CSV with a header row.
CATALOG = {
    "catalog_products": (
        "product_id bigint, product_name string, sku string, category string, subcategory string, "
        "unit_price decimal(12,2), cost_price decimal(12,2), margin_pct double, brand string, "
        "is_active boolean, launch_date date, weight_lbs double, is_featured boolean"
    ),
    "catalog_stores": (
        "store_id bigint, store_name string, store_type string, channel string, city string, "
        "state string, region string, opened_date date, sq_footage bigint, district string, "
        "is_active boolean, manager_name string"
    ),
    "catalog_campaigns": (
        "campaign_id bigint, campaign_name string, channel string, campaign_type string, "
        "start_date date, end_date date, budget_usd bigint, target_segment string, "
        "utm_source string, utm_medium string, utm_campaign string, is_active boolean"
    ),
    "catalog_promotions": (
        "promotion_id bigint, promotion_code string, promotion_name string, discount_type string, "
        "discount_value double, min_order_amount double, start_date date, end_date date, "
        "channel string, is_stackable boolean, max_redemptions bigint, is_active boolean"
    ),
    "catalog_payment_methods": (
        "payment_method_id bigint, payment_method string, payment_category string, "
        "processor string, processing_fee_pct double, supports_refund boolean, "
        "supports_partial_refund boolean, is_active boolean"
    ),
}

ALL = {**RAW, **CATALOG}
