"""Queries of the data-processing problems 1, 2, 4 and 5, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.blank import is_blank
from weir.operators import late_events, orphans, profile, schema_fold
from weir.sources.session import cut
from weir.sources.tables import read_table

ORDER_EVENTS = {"key": "order_id", "event": "order_timestamp", "arrival": "ingestion_timestamp", "group": "currency", "amount": "total_amount"}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    late = late_events.late_outcomes(read_table(spark, folder, "silver_orders"), **ORDER_EVENTS)
    return late.select(F.col("record_key").alias("order_id"), F.date_format("event_day", "yyyy-MM-dd").alias("order_day"), "outcome")


def p1_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue per order day and currency as it stood after each day of arrival."""
    revised = late_events.period_revisions(read_table(spark, folder, "silver_orders"), **ORDER_EVENTS)
    return revised.select(F.col("event_day").alias("order_date"), F.col("group_key").alias("currency"), "published_day", F.col("total_amount").alias("total_revenue"), F.col("record_count").alias("order_count"), "revision")


def _order_of(table: str, df: DataFrame, loads: DataFrame) -> DataFrame:
    """The order of the loads of silver_orders or of metrics; ``loads`` has a row or more per load."""
    if table == "silver_orders":
        return profile.load_order(loads.select("load_id").distinct().withColumn("stream", F.regexp_replace("load_id", "[^/]*$", "")), "stream", ["load_id"])
    runs = df.where(~is_blank(F.col("run_id"))).groupBy(F.col("run_id").alias("load_id")).agg(F.min("pipeline_name").alias("stream"), F.min("run_timestamp").alias("at"))
    return profile.load_order(runs, "stream", ["at", "load_id"])


# The columns checked in each table, as in column_specs.
CHECKED = {"silver_orders": ["customer_id", "quantity", "unit_price"], "metrics": ["rule_name", "dataset_name"]}
LOAD = {"silver_orders": "source_file", "metrics": "run_id"}
DISTINCT_CHECKED, SHIFT_CHECKED = ["customer_id", "rule_name", "dataset_name"], ["rule_name", "dataset_name"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    declared = read_table(spark, folder, "column_specs").collect()  # a row per checked column
    found = []
    for table, columns in CHECKED.items():
        df, load = read_table(spark, folder, table), F.col(LOAD[table])
        specs = [r for r in declared if r["table_name"] == table]
        masks = cut(profile.mask_counts(df, load, columns, specs))
        distinct, shift = ([c for c in columns if c in of] for of in (DISTINCT_CHECKED, SHIFT_CHECKED))
        values = profile.value_histogram(df, load, distinct)
        issues = profile.load_issues(masks, values, specs, _order_of(table, df, masks), distinct, shift)
        found.append(issues.select(F.lit(table).alias("table_name"), "column_name", "load_id", "issue"))
    return found[0].unionByName(found[1])


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of both tables by load: rows, nulls, distinct values, range, dominant mask."""
    found = []
    for table in ("silver_orders", "metrics"):
        df = read_table(spark, folder, table)
        masks = profile.exact_mask_histogram(df, F.col(LOAD[table]), [c for c in df.columns if c != LOAD[table]])
        found.append(profile.table_profile(masks).withColumn("table_name", F.lit(table)))
    return found[0].unionByName(found[1])


def p2_mask_shift(spark: SparkSession, folder: str) -> DataFrame:
    """How far the masks of every column moved against the load before."""
    found = []
    for table in CHECKED:
        df = read_table(spark, folder, table)
        masks = cut(profile.mask_histogram(df, F.col(LOAD[table]), [c for c in df.columns if c != LOAD[table]]))
        totals = masks.where("mask is not null").groupBy("load_id", "column_name").agg(F.sum("n").alias("value_count"))
        moved = profile.divergence(masks, totals, _order_of(table, df, masks), "mask")
        found.append(moved.select(F.lit(table).alias("table_name"), "column_name", "load_id", F.round("divergence", 9).alias("divergence")))
    return found[0].unionByName(found[1])


def p2_rare_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Masks of the checked text columns that few values of their load have: likely violations."""
    found = []
    for table in ("silver_orders", "metrics"):
        masks = profile.mask_histogram(read_table(spark, folder, table), F.col(LOAD[table]), [c for c in CHECKED[table] if c in DISTINCT_CHECKED])
        found.append(profile.rare_masks(masks).select(F.lit(table).alias("table_name"), "column_name", "load_id", "mask", "n", "value_count"))
    return found[0].unionByName(found[1])


def p2_rare_masks_all(spark: SparkSession, folder: str) -> DataFrame:
    """``p2_rare_masks``, whose SQL covers three columns, over every column of both tables."""
    found = []
    for table in ("silver_orders", "metrics"):
        df = read_table(spark, folder, table)
        masks = profile.mask_histogram(df, F.col(LOAD[table]), [c for c in df.columns if c != LOAD[table]])
        found.append(profile.rare_masks(masks).select(F.lit(table).alias("table_name"), "column_name", "load_id", "mask", "n", "value_count"))
    return found[0].unionByName(found[1])


# The table that each reference of silver_orders points to.
REFERS = {"customer_id": "silver_customers", "product_id": "silver_products"}


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The references of silver_orders, and the changes of the keys they name."""
    orders, history = read_table(spark, folder, "silver_orders"), read_table(spark, folder, "key_history")
    cells = F.array(*[F.struct(F.lit(c).alias("field_name"), F.lit(t).alias("ref_table"), F.upper(F.trim(F.col(c))).alias("ref_key")) for c, t in REFERS.items()])
    references = (
        orders.select("order_id", F.to_date("order_timestamp").alias("order_day"), F.col("ingestion_timestamp").alias("at"), F.explode(cells).alias("_c"))
        .select("order_id", "order_day", "at", "_c.*")
        .where("ref_key <> ''")
    )
    return references, orphans.existence_changes(history, "ref_table", "key_value", "change_kind", "changed_at")


def _order_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_references(*_references(spark, folder), ["order_id", "order_day", "field_name"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _order_orphans(spark, folder).select("order_id", "field_name", "key_state").distinct()


def p4_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per referenced table, order day and state."""
    return _order_orphans(spark, folder).groupBy("ref_table", "order_day", "key_state").agg(F.count(F.lit(1)).alias("reference_count"))


def p4_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The current report: keys that orders name and that do not exist after all changes."""
    return orphans.orphan_keys(orphans.carry(None, orphans.key_deltas(*_references(spark, folder))))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    changes = schema_fold.layout_changes(read_table(spark, folder, "raw_order_files"))
    return changes.select("file_id", "field_name", "change_kind").distinct()


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all files under one schema."""
    return schema_fold.read_consistent(read_table(spark, folder, "raw_order_files"))


def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    """The values of ``p5_records``, one row each, as text; its columns depend on what the files hold."""
    records = p5_records(spark, folder)
    fields = [c for c in records.columns if c not in ("file_id", "line_no", "unfit_fields")]
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])
    return records.select("file_id", "line_no", F.explode(cells).alias("_c")).select("file_id", "line_no", "_c.field_name", "_c.value").where("value is not null")


QUERIES = {f.__name__: f for f in (p1_found, p1_revenue, p2_found, p2_profile, p2_mask_shift, p2_rare_masks, p2_rare_masks_all, p4_found, p4_daily, p4_ledger, p5_found, p5_records, p5_values)}
