"""Declared tables of the layers, and the contracts on them."""

from __future__ import annotations

from pyspark.sql.types import StructType

from weir.model import Contract

# The declared columns of each table; a name with ! may not be null.
TABLES = {
    "bronze_raw_events": "order_id! string, customer_id string, product_id string, order_status string, quantity int, unit_price double, currency string, order_timestamp string",
    "silver_orders": "order_id! string, customer_id! string, product_id! string, order_status! string, quantity! int, unit_price! double, total_amount! double, currency! string, order_timestamp! timestamp, order_date! date, ingestion_timestamp! timestamp, source_file string",
    "silver_customers": "customer_id! string, first_order_date date, last_order_date date, total_orders! bigint, total_spend! double, avg_order_value double, preferred_currency string, last_updated! timestamp",
    "silver_products": "product_id! string, total_quantity_sold! bigint, total_revenue! double, avg_unit_price double, min_unit_price double, max_unit_price double, order_count! bigint, last_sold_date date, last_updated! timestamp",
    "gold_daily_revenue": "order_date! date, total_revenue! double, order_count! bigint, avg_order_value double, unique_customers! bigint, unique_products! bigint, currency! string, computed_at! timestamp",
    "gold_product_performance": "product_id! string, product_name string, total_quantity_sold! bigint, total_revenue! double, avg_unit_price double, order_count! bigint, unique_customers! bigint, first_sold_date date, last_sold_date date, revenue_rank int, computed_at! timestamp",
    "gold_customer_ltv": "customer_id! string, total_orders! bigint, total_spend! double, avg_order_value double, first_order_date date, last_order_date date, customer_tenure_days int, orders_per_month double, ltv_segment string, computed_at! timestamp",
    "metrics": "run_id! string, dataset_name! string, layer! string, rule_name! string, rule_version! string, metric_name! string, metric_value! double, passed! boolean, severity! string, total_records! bigint, failed_records! bigint, run_timestamp! timestamp, pipeline_name string, metadata_json string",
    "rule_results": "run_id! string, rule_name! string, dataset_name! string, record_id string, failure_reason string, record_snapshot string, run_timestamp! timestamp",
}
_JSON_NAMES = {"int": "integer", "bigint": "long"}
STATUSES = ("pending", "confirmed", "shipped", "delivered", "cancelled", "returned", "refunded")
CURRENCIES = ("USD", "EUR", "GBP", "INR", "JPY", "CAD", "AUD")


def schema(table: str) -> StructType:
    """The declared schema of a table, nullability included."""
    found = StructType()
    for part in TABLES[table].split(", "):
        name, kind = part.split(" ")
        found = found.add(name.rstrip("!"), _JSON_NAMES.get(kind, kind), not name.endswith("!"))
    return found


# Table -> layer, key, least share of values by column, most duplicates, hours of
# freshness, its column, least rows, whether columns may be added.
_CONTRACTS = {
    "bronze_raw_events": ("bronze", ("order_id",), {"order_id": 1.0, "customer_id": 0.9}, 0.05, 24.0, None, 100, False),
    "silver_orders": ("silver", ("order_id",), {"order_id": 1.0, "customer_id": 1.0, "product_id": 1.0}, 0.0, 4.0, "ingestion_timestamp", 50, True),
    "silver_customers": ("silver", ("customer_id",), {"customer_id": 1.0}, 0.0, 4.0, "last_updated", 0, True),
    "silver_products": ("silver", ("product_id",), {"product_id": 1.0}, 0.0, 4.0, "last_updated", 0, True),
    "gold_daily_revenue": ("gold", ("order_date", "currency"), {"order_date": 1.0, "total_revenue": 1.0}, 0.0, 2.0, "computed_at", 0, True),
    "gold_product_performance": ("gold", ("product_id",), {"product_id": 1.0}, 0.0, 2.0, "computed_at", 0, True),
    "gold_customer_ltv": ("gold", ("customer_id",), {"customer_id": 1.0}, 0.0, 2.0, "computed_at", 0, True),
}


def contract(table: str) -> Contract:
    layer, key, not_null, duplicates, hours, column, rows, evolve = _CONTRACTS[table]
    return Contract(table, layer, schema(table), key, evolve, dict(not_null), duplicates, hours, column, rows)


CONTRACT_NAMES = tuple(_CONTRACTS)
