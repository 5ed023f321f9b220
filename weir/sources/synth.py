"""Deterministic order events and faults. Every draw hashes the row and a salt, so the same seed gives
the same rows whatever the partitioning."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.schemas import STATUSES, schema

PRODUCTS, CUSTOMERS = 20, 500
# Chosen here: value and its share of rows, in percent.
STATUS_SHARES = dict(zip(STATUSES, (10, 15, 20, 40, 7, 5, 3), strict=True))
CURRENCY_SHARES = {"USD": 60, "EUR": 20, "GBP": 10, "INR": 5, "CAD": 5}


def draw(salt: str, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys and the salt alone: 28 bits of their MD5."""
    text = F.concat_ws(":", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys], F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("double") / float(1 << 28)


def choose(u: Column, shares: dict[str, float]) -> Column:
    """The value whose stretch of the cumulated shares holds ``u``."""
    total = sum(shares.values())
    steps = list(zip(shares, (s / total for s in accumulate(shares.values())), strict=True))
    return reduce(lambda rest, step: F.when(u < step[1], F.lit(step[0])).otherwise(rest), reversed(steps[:-1]), F.lit(steps[-1][0]))


def quantity(u: Column, v: Column) -> Column:
    """Mostly one to three; one in twenty orders from four to ten, evenly."""
    return choose(u, {"1": 60, "2": 25, "3": 10, "0": 5}).cast("int") + F.when(u >= 0.95, F.floor(v * 7).cast("int") + 4).otherwise(0)


def list_price(product: Column) -> Column:
    """Prices from 9.99 to 399.99, spread evenly over the products."""
    return F.round(9.99 + (product - 1) * (390.0 / (PRODUCTS - 1)), 2)


def products(spark: SparkSession) -> DataFrame:
    n = F.col("id")
    return spark.range(1, PRODUCTS + 1).select(F.format_string("PROD-%03d", n).alias("product_id"), F.format_string("Product %03d", n).alias("product_name"), list_price(n).alias("list_price"))


def customers(spark: SparkSession) -> DataFrame:
    return spark.range(1, CUSTOMERS + 1).select(F.format_string("CUST-%04d", "id").alias("customer_id"))


def clean_events(spark: SparkSession, rows: int, seed: int = 42, start: str = "2024-01-01", end: str = "2024-12-31") -> DataFrame:
    """``rows`` events in the Bronze layout: skewed customers and products, times as text."""
    def u(salt: str) -> Column:
        return draw(f"{seed}:{salt}", "row")

    product = (F.floor(F.pow(u("product"), 2.0) * PRODUCTS) + 1).cast("int")
    span = f"timestampdiff(SECOND, timestamp_ntz'{start} 00:00:00', timestamp_ntz'{end} 23:59:59')"
    return (
        spark.range(rows)
        .withColumnRenamed("id", "row")
        .withColumn("_p", product)
        .select(
            F.format_string("ORD-%08d", "row").alias("order_id"),
            F.format_string("CUST-%04d", (F.floor(F.pow(u("customer"), 3.0) * CUSTOMERS) + 1).cast("int")).alias("customer_id"),
            F.format_string("PROD-%03d", "_p").alias("product_id"),
            choose(u("status"), STATUS_SHARES).alias("order_status"),
            quantity(u("size"), u("many")).alias("quantity"),
            F.round(list_price(F.col("_p")) * (0.9 + 0.2 * u("price")), 2).alias("unit_price"),
            choose(u("currency"), CURRENCY_SHARES).alias("currency"),
            F.date_format(F.expr(f"timestamp_ntz'{start} 00:00:00'") + F.make_dt_interval(secs=F.floor(u("time") * F.expr(span))), "yyyy-MM-dd HH:mm:ss").alias("order_timestamp"),
        )
        .to(_nullable("bronze_raw_events"))
    )


def _nullable(table: str):
    from weir.sources.store import nullable

    return nullable(schema(table))


@dataclass(frozen=True)
class Faults:
    """Rates of injected faults, 0 to 1."""

    null_customer: float = 0.05
    duplicate: float = 0.03
    bad_time: float = 0.02
    bad_status: float = 0.02
    negative_quantity: float = 0.01
    unknown_product: float = 0.03
    bad_currency: float = 0.02
    extra_column: bool = True
    missing_column: str | None = None
    seed: int = 42


# What faults write.
BAD_STATUSES = ("YOLO", "TEST", "PROCESSING", "unknown", "VOID")
BAD_CURRENCIES = ("BTC", "XYZ", "ABC", "GOLD", "")
BAD_TIMES = {"NOT_A_DATE": 40, "2024/13/45 99:99:99": 30, "": 20, "null": 10}
TIERS = ("gold", "silver", "bronze")


def _pick(salt: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(draw(salt, "order_id") * len(values)) + 1).cast("int"))


def null_customers(df: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    return df.withColumn("customer_id", F.when(draw(f"{seed}:nc", "order_id") >= rate, F.col("customer_id")))


def bad_times(df: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    return df.withColumn("order_timestamp", F.when(draw(f"{seed}:bt", "order_id") < rate, choose(draw(f"{seed}:btv", "order_id"), BAD_TIMES)).otherwise(F.col("order_timestamp")))


def bad_statuses(df: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    return df.withColumn("order_status", F.when(draw(f"{seed}:bs", "order_id") < rate, _pick(f"{seed}:bsv", BAD_STATUSES)).otherwise(F.col("order_status")))


def negative_quantities(df: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    return df.withColumn("quantity", F.when(draw(f"{seed}:nq", "order_id") < rate, -(F.floor(draw(f"{seed}:nqv", "order_id") * 5) + 1).cast("int")).otherwise(F.col("quantity")))


def unknown_products(df: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    return df.withColumn("product_id", F.when(draw(f"{seed}:up", "order_id") < rate, F.format_string("INVALID-%03d", (F.floor(draw(f"{seed}:upv", "order_id") * 999) + 1).cast("int"))).otherwise(F.col("product_id")))


def bad_currencies(df: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    return df.withColumn("currency", F.when(draw(f"{seed}:bc", "order_id") < rate, _pick(f"{seed}:bcv", BAD_CURRENCIES)).otherwise(F.col("currency")))


def near_duplicates(df: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Adds copies of some rows with other seconds in the time text."""
    second = F.lpad((F.floor(draw(f"{seed}:nds", "order_id") * 60)).cast("int").cast("string"), 2, "0")
    copies = df.where(draw(f"{seed}:nd", "order_id") < rate).withColumn("order_timestamp", F.when(F.length("order_timestamp") == 19, F.concat(F.substring("order_timestamp", 1, 17), second)).otherwise(F.col("order_timestamp")))
    return df.unionByName(copies)


def extra_column(df: DataFrame, seed: int = 42) -> DataFrame:
    return df.withColumn("loyalty_tier", _pick(f"{seed}:lt", TIERS))


def inject(df: DataFrame, faults: Faults | None = None) -> DataFrame:
    """All faults: of values first, then near duplicates, then of the layout."""
    f = faults or Faults()
    for step, rate in ((null_customers, f.null_customer), (bad_times, f.bad_time), (bad_statuses, f.bad_status), (negative_quantities, f.negative_quantity), (unknown_products, f.unknown_product), (bad_currencies, f.bad_currency), (near_duplicates, f.duplicate)):
        if rate > 0:
            df = step(df, rate, f.seed)
    df = extra_column(df, f.seed) if f.extra_column else df
    return df.drop(f.missing_column) if f.missing_column else df


def drift_batches(spark: SparkSession, rows: int = 2000, seed: int = 42) -> dict[str, DataFrame]:
    """Four batches: the base, one column more, one less, one of another type."""
    base = clean_events(spark, rows, seed)
    return {"v1": base, "v2": extra_column(base, seed), "v3": base.drop("currency"), "v4": base.withColumn("quantity", F.col("quantity").cast("string"))}
