"""Bronze, Silver and Gold as pure transforms of DataFrames."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.model import Duplicates
from weir.operators.ordering import global_rank
from weir.operators.rules import deduplicate
from weir.schemas import schema

BRONZE_COLUMNS = schema("bronze_raw_events").fieldNames()
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def run_time(at: datetime | None = None) -> Column:
    """A literal timestamp, so that a run has one time however often its plan is evaluated."""
    at = at or datetime.now(timezone.utc)
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(int(at.timestamp() * 1_000_000)))


def bronze(raw: DataFrame, run_id: str, at: datetime | None = None) -> DataFrame:
    """The expected columns that are present, in the expected order, with run metadata."""
    held = [F.col(f"`{c}`") for c in BRONZE_COLUMNS if c in raw.columns]
    return raw.select(*held).withColumns({"_ingestion_timestamp": run_time(at), "_run_id": F.lit(run_id)})


def readable_time(value: Column) -> Column:
    return F.try_to_timestamp(value, F.lit(TIME_FORMAT))


def rejection(df: DataFrame) -> Column:
    """Why Silver cannot take a Bronze row; null if it can. All reasons, in a fixed order."""
    keys = [F.when(F.col(c).isNull(), F.lit(f"{c}_null")) for c in ("order_id", "customer_id", "product_id")]
    reasons = F.array_compact(F.array(*keys, F.when(readable_time(F.col("order_timestamp")).isNull(), F.lit("order_timestamp_unreadable"))))
    return F.when(F.size(reasons) > 0, F.array_join(reasons, ","))


def split_silver(bronze_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that Silver takes, rows for quarantine with ``_reasons``)."""
    marked = bronze_df.withColumn("_reasons", rejection(bronze_df))
    return marked.where("_reasons is null").drop("_reasons"), marked.where("_reasons is not null")


def silver_orders(bronze_df: DataFrame, at: datetime | None = None, source_file: str = "bronze_raw_events") -> DataFrame:
    """Rows with keys and a readable time, one per order (the latest), with amount and day."""
    clean, _ = split_silver(bronze_df)
    timed = clean.withColumn("order_timestamp", readable_time(F.col("order_timestamp")))
    latest = deduplicate(timed, Duplicates("silver_latest", key_columns=("order_id",), order_by="order_timestamp", keep="last"))
    return latest.select(
        "order_id", "customer_id", "product_id", "order_status", "quantity", "unit_price",
        F.round(F.col("quantity") * F.col("unit_price"), 2).alias("total_amount"),
        "currency", "order_timestamp", F.to_date("order_timestamp").alias("order_date"), run_time(at).alias("ingestion_timestamp"), F.lit(source_file).alias("source_file"),
    )


def money(value: Column) -> Column:
    """Fixed point with eight places, which adds up exactly in any order; null for what that cannot hold."""
    return F.when(~F.isnan(value), value).try_cast("decimal(28,8)")


def beyond_money(value: Column) -> Column:
    """What ``money`` cannot hold, infinite values included; not-a-number is left out."""
    return F.when(~F.isnan(value) & money(value).isNull(), value)


def _sum(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.coalesce(F.sum(money(v)).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(beyond_money(v)), F.lit(0.0))


def _mean(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.try_divide(_sum(name), F.count(F.when(~F.isnan(v), v)))


def split_orphans(orders: DataFrame, rejected: DataFrame, key: str = "order_id") -> DataFrame:
    """Orders whose key is not among the rejected ones; null keys stay."""
    return orders.join(rejected.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def silver_customers(orders: DataFrame, at: datetime | None = None) -> DataFrame:
    """One row per customer. The preferred currency is the most frequent, ties by name.

    Counts per (customer, currency) combine first, so a customer with a third of all orders is a few
    rows when customers are put together.
    """
    amount = F.col("total_amount").cast("double")
    per_currency = orders.groupBy("customer_id", "currency").agg(
        F.min("order_date").alias("_first"), F.max("order_date").alias("_last"), F.count(F.lit(1)).alias("_n"), F.sum(money(amount)).alias("_spend"), F.sum(beyond_money(amount)).alias("_beyond"), F.count(F.when(~F.isnan(amount), amount)).alias("_amounts")
    )
    by_use = F.when(F.col("currency").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("currency").alias("currency")))
    spend = F.coalesce(F.sum("_spend").cast("double"), F.lit(0.0)) + F.coalesce(F.sum("_beyond"), F.lit(0.0))
    return per_currency.groupBy("customer_id").agg(
        F.min("_first").alias("first_order_date"),
        F.max("_last").alias("last_order_date"),
        F.sum("_n").alias("total_orders"),
        spend.alias("total_spend"),
        F.try_divide(spend, F.sum("_amounts")).alias("avg_order_value"),
        F.min(by_use)["currency"].alias("preferred_currency"),
        run_time(at).alias("last_updated"),
    )


def silver_products(orders: DataFrame, at: datetime | None = None) -> DataFrame:
    price = F.when(~F.isnan(F.col("unit_price").cast("double")), F.col("unit_price"))
    return orders.groupBy("product_id").agg(
        F.sum("quantity").alias("total_quantity_sold"),
        _sum("total_amount").alias("total_revenue"),
        _mean("unit_price").alias("avg_unit_price"),
        F.min(price).alias("min_unit_price"),
        F.max(price).alias("max_unit_price"),
        F.count(F.lit(1)).alias("order_count"),
        F.max("order_date").alias("last_sold_date"),
        run_time(at).alias("last_updated"),
    )


def gold_daily_revenue(orders: DataFrame, at: datetime | None = None) -> DataFrame:
    return orders.groupBy("order_date", "currency").agg(
        _sum("total_amount").alias("total_revenue"),
        F.count(F.lit(1)).alias("order_count"),
        _mean("total_amount").alias("avg_order_value"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("product_id").alias("unique_products"),
        run_time(at).alias("computed_at"),
    )


def gold_product_performance(orders: DataFrame, names: DataFrame | None = None, at: datetime | None = None) -> DataFrame:
    """One row per product with its rank by revenue (ties by id). ``names`` (product_id, product_name)
    fills the names."""
    per_product = orders.groupBy("product_id").agg(
        F.sum("quantity").alias("total_quantity_sold"),
        _sum("total_amount").alias("total_revenue"),
        _mean("unit_price").alias("avg_unit_price"),
        F.count(F.lit(1)).alias("order_count"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.min("order_date").alias("first_sold_date"),
        F.max("order_date").alias("last_sold_date"),
    )
    ranked = global_rank(per_product, "total_revenue", "product_id", "revenue_rank")
    ranked = ranked.join(names.select("product_id", "product_name"), "product_id", "left") if names is not None else ranked.withColumn("product_name", F.lit(None).cast("string"))
    return ranked.select(*[c for c in schema("gold_product_performance").fieldNames() if c != "computed_at"], run_time(at).alias("computed_at"))


# Lifetime spend from which a customer is of a segment.
SEGMENTS = [("high", 500.0), ("medium", 100.0)]


def gold_customer_ltv(orders: DataFrame, at: datetime | None = None) -> DataFrame:
    """One row per customer: totals, tenure in days, orders per 30 days, segment by spend."""
    per_customer = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"), _sum("total_amount").alias("total_spend"), _mean("total_amount").alias("avg_order_value"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date")
    )
    tenure = F.datediff("last_order_date", "first_order_date")
    segment = F.lit("low")
    for label, least in reversed(SEGMENTS):
        segment = F.when(F.col("total_spend") >= least, F.lit(label)).otherwise(segment)
    rate = F.when(tenure > 0, F.round(F.col("total_orders") / (tenure / 30), 2)).otherwise(F.col("total_orders").cast("double"))
    return per_customer.select("*", tenure.alias("customer_tenure_days"), rate.alias("orders_per_month"), segment.alias("ltv_segment"), run_time(at).alias("computed_at"))
