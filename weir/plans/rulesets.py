"""The stock rule sets of the layers."""

from __future__ import annotations

from weir.model import AcceptedValues, DistributionAnomaly, Duplicates, Freshness, Layer, NotNull, PositiveNumeric, RowCountAnomaly, Rule, SchemaDrift, Severity, UniqueKey
from weir.schemas import CURRENCIES, STATUSES, schema

C, W = Severity.CRITICAL, Severity.WARNING


def bronze_rules() -> list[Rule]:
    at = {"layer": Layer.BRONZE}
    return [
        NotNull("bronze_order_id_not_null", severity=C, column="order_id", **at),
        NotNull("bronze_customer_id_not_null", severity=W, column="customer_id", **at),
        UniqueKey("bronze_order_id_unique", severity=W, columns=("order_id",), **at),
        AcceptedValues("bronze_order_status_valid", severity=W, column="order_status", values=STATUSES, **at),
        AcceptedValues("bronze_currency_valid", severity=W, column="currency", values=CURRENCIES, **at),
        PositiveNumeric("bronze_quantity_positive", severity=W, column="quantity", **at),
        PositiveNumeric("bronze_unit_price_positive", severity=W, column="unit_price", **at),
        SchemaDrift("bronze_schema_drift", severity=C, expected_columns=tuple(schema("bronze_raw_events").fieldNames()), **at),
    ]


def silver_rules() -> list[Rule]:
    at = {"layer": Layer.SILVER}
    return [
        NotNull("silver_customer_id_not_null", severity=C, column="customer_id", **at),
        UniqueKey("silver_order_id_unique", severity=C, columns=("order_id",), **at),
        Freshness("silver_freshness_check", severity=W, column="ingestion_timestamp", max_age_hours=4.0, **at),
        Duplicates("silver_dedup_orders", severity=C, key_columns=("order_id",), order_by="order_timestamp", keep="last", **at),
        DistributionAnomaly("silver_price_distribution", severity=W, column="unit_price", z_threshold=3.0, max_drift_pct=25.0, **at),
        DistributionAnomaly("silver_quantity_distribution", severity=W, column="quantity", z_threshold=3.0, max_drift_pct=30.0, **at),
    ]


def gold_rules() -> list[Rule]:
    at = {"layer": Layer.GOLD}
    return [
        RowCountAnomaly("gold_daily_revenue_row_count", severity=C, min_deviation_pct=-30.0, max_deviation_pct=50.0, lookback=10, **at),
        Freshness("gold_freshness_check", severity=C, column="computed_at", max_age_hours=2.0, **at),
        DistributionAnomaly("gold_revenue_distribution", severity=C, column="total_revenue", z_threshold=2.5, max_drift_pct=20.0, **at),
    ]


def strict_silver_rules() -> list[Rule]:
    """Opt-in: the row rules that keep bad values from Gold."""
    at = {"layer": Layer.SILVER, "severity": C}
    return [
        AcceptedValues("silver_order_status_valid", column="order_status", values=STATUSES, **at),
        AcceptedValues("silver_currency_valid", column="currency", values=CURRENCIES, **at),
        PositiveNumeric("silver_quantity_positive", column="quantity", **at),
        PositiveNumeric("silver_unit_price_positive", column="unit_price", **at),
    ]
