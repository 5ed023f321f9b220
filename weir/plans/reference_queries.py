"""Queries of the rules, contracts, transforms, metrics and SQL checks, over whole tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir import schemas
from weir.functions import sqlchecks
from weir.model import AcceptedValues, DistributionAnomaly, Duplicates, Freshness, NotNull, PositiveNumeric, ReferentialIntegrity, RowCountAnomaly, Rule, SchemaDrift, Severity, UniqueKey
from weir.operators import contracts, medallion, metrics, quarantine
from weir.operators.rules import Context, deduplicate
from weir.plans import fused, pipeline, rulesets
from weir.sources import synth
from weir.sources.paths import LAYERS, layer_paths
from weir.sources.session import ensure_checkpoint_dir
from weir.sources.store import TableStore
from weir.sources.tables import read_table

NOW = datetime(2024, 12, 16, tzinfo=timezone.utc)


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "silver_orders")


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    """silver_orders in the layout of Bronze."""
    orders = _orders(spark, folder)
    return orders.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "order_timestamp" else c for c in schemas.schema("bronze_raw_events").fieldNames()])


def rule_not_null(spark: SparkSession, folder: str) -> DataFrame:
    r = fused.check(_orders(spark, folder), NotNull("customer_not_null", column="customer_id"))
    return spark.createDataFrame([(r.total_records, r.failed_records, r.failure_rate, r.passed)], "total_records bigint, failed_records bigint, failure_rate double, passed boolean")


def rule_unique_key(spark: SparkSession, folder: str) -> DataFrame:
    m = fused.check(_orders(spark, folder), UniqueKey("order_unique", columns=("order_id",)))
    found = (m.total_records, m.metadata["duplicate_groups"], m.metadata["total_duplicate_records"], m.failed_records)
    return spark.createDataFrame([found], "total_records bigint, duplicate_groups bigint, duplicate_records bigint, excess_records bigint")


def rule_unique_key_failures(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of every repeated key."""
    r = fused.check(read_table(spark, folder, "lineitem"), UniqueKey("line_unique", columns=("l_orderkey", "l_linenumber")))
    return r.failed_df.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("row_count"))


def rule_accepted_values(spark: SparkSession, folder: str) -> DataFrame:
    r = fused.check(_orders(spark, folder), AcceptedValues("currency_known", column="currency", values=schemas.CURRENCIES))
    return r.failed_df.groupBy("currency").agg(F.count(F.lit(1)).alias("violation_count"))


def rule_positive_numeric(spark: SparkSession, folder: str) -> DataFrame:
    r = fused.check(_orders(spark, folder), PositiveNumeric("price_positive", column="unit_price"))
    found = (r.total_records, r.failed_records, r.metadata["nan_count"], r.metadata["min_failing_value"], r.metadata["max_failing_value"], round(r.metadata["avg_failing_value"], 6))
    return spark.createDataFrame([found], "total_records bigint, failed_records bigint, nan_count bigint, min_failing_value double, max_failing_value double, avg_failing_value double")


def rule_freshness(spark: SparkSession, folder: str) -> DataFrame:
    r = fused.check(_orders(spark, folder), Freshness("orders_fresh", column="ingestion_timestamp", max_age_hours=4.0), reference_time=NOW)
    return spark.createDataFrame([(r.metadata["age_hours"], r.metadata["breach_hours"], r.passed)], "age_hours double, breach_hours double, passed boolean")


LATEST = Duplicates("order_duplicates", key_columns=("order_id",), order_by="order_timestamp", keep="last")


def rule_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    r = fused.check(_orders(spark, folder), LATEST)
    return spark.createDataFrame([(r.total_records, r.failed_records, r.metadata["dedup_ratio"])], "total_records bigint, surplus_records bigint, dedup_ratio double")


def op_deduplicate(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicate(_orders(spark, folder), LATEST)


def op_surplus(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that ``op_deduplicate`` leaves out."""
    return fused.check(_orders(spark, folder), LATEST).failed_df


def rule_schema_drift(spark: SparkSession, folder: str) -> DataFrame:
    """The orders against the Bronze layout: what was added, removed and retyped."""
    rule = SchemaDrift("bronze_layout", expected_schema=schemas.schema("bronze_raw_events"))
    m = fused.check(_orders(spark, folder), rule).metadata
    rows = [("added", c) for c in m["added_columns"]] + [("removed", c) for c in m["removed_columns"]] + [("retyped", c) for c in m["type_changes"]]
    return spark.createDataFrame(rows, "change string, column_name string")


def rule_referential_integrity(spark: SparkSession, folder: str) -> DataFrame:
    rule = ReferentialIntegrity("customer_known", child_column="customer_id", parent_table="silver_customers", parent_column="customer_id")
    r = fused.check(_orders(spark, folder), rule, parents={"silver_customers": read_table(spark, folder, "silver_customers")})
    return r.failed_df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orphan_count"))


def rule_row_count_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    """The number of orders against the last ten runs in the metrics."""
    history = metrics.recent_row_counts(read_table(spark, folder, "metrics"), "silver_orders")
    m = fused.check(_orders(spark, folder), RowCountAnomaly("orders_volume"), historical_counts=history).metadata
    found = (m["current_count"], m["baseline_min"], m["baseline_max"], m["baseline_mean"], m["baseline_stddev"], m["deviation_pct"], m["lookback_runs"], m["anomaly_type"])
    return spark.createDataFrame([found], "current_count bigint, baseline_min bigint, baseline_max bigint, baseline_mean double, baseline_stddev double, deviation_pct double, lookback_runs int, anomaly_type string")


PRICE = DistributionAnomaly("price_distribution", column="l_extendedprice", approximate=False)


def rule_distribution_stats(spark: SparkSession, folder: str) -> DataFrame:
    s = fused.check(read_table(spark, folder, "lineitem"), PRICE).metadata["current_stats"]
    found = (s["count"], s["min"], s["max"], s["p25"], s["p50"], s["p75"], round(s["mean"], 4), round(s["stddev"], 4), round(s["skewness"], 6), round(s["kurtosis"], 6))
    return spark.createDataFrame([found], "value_count bigint, min_value double, max_value double, p25 double, p50 double, p75 double, mean double, stddev double, skewness double, kurtosis double")


def rule_distribution_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities ordered from November on against those before."""
    orders = _orders(spark, folder)
    before, after = (orders.where(F.col("order_date") < "2024-11-01"), orders.where(F.col("order_date") >= "2024-11-01"))
    rule = DistributionAnomaly("quantity_drift", column="quantity", approximate=False)
    history = fused.check(before, rule).metadata["current_stats"]
    m = fused.check(after, rule, historical_stats={"quantity": history}).metadata
    found = (m["z_score"], *(m["percentile_drift"][b] for b in ("p25", "p50", "p75")), bool(m["anomalies"]))
    return spark.createDataFrame([found], "z_score double, drift_p25 double, drift_p50 double, drift_p75 double, is_anomaly boolean")


def rules_bronze(spark: SparkSession, folder: str) -> DataFrame:
    """The stock Bronze set in one fused plan."""
    results = fused.checks(_raw(spark, folder), rulesets.bronze_rules(), "bronze_raw_events")
    return _outcomes(spark, results)


def _outcomes(spark: SparkSession, results: list) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.total_records, r.failed_records, r.passed, r.severity) for r in results], "rule_id string, total_records bigint, failed_records bigint, passed boolean, severity string")


def rules_silver(spark: SparkSession, folder: str) -> DataFrame:
    """The stock Silver set; distributions establish their baseline."""
    return _outcomes(spark, fused.checks(_orders(spark, folder), rulesets.silver_rules(), "silver_orders", Context(reference_time=NOW)))


def rules_gold(spark: SparkSession, folder: str) -> DataFrame:
    """The stock Gold set with exact percentiles, against the statistics of the days before November."""
    daily = read_table(spark, folder, "gold_daily_revenue")
    rules = [replace(r, approximate=False) if type(r) is DistributionAnomaly else r for r in rulesets.gold_rules()]
    rule = next(r for r in rules if type(r) is DistributionAnomaly)
    before = fused.check(daily.where("order_date < '2024-11-01'"), rule).metadata["current_stats"]
    context = Context(reference_time=NOW, historical_counts=[100, 120, 140], historical_stats={rule.column: before})
    return _outcomes(spark, fused.checks(daily, rules, "gold_daily_revenue", context))


@dataclass(frozen=True)
class _Unknown(Rule):
    """A rule of a type that nobody registered."""


def rule_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of rules that are disabled, unknown, without their column, or fail as they run."""
    rules = [
        NotNull("fine", column="order_id"),
        NotNull("off", column="order_id", enabled=False),
        _Unknown("odd"),
        NotNull("no_column", column="nothing", severity=Severity.CRITICAL),
        ReferentialIntegrity("no_parent", child_column="customer_id", parent_table="nowhere", parent_column="id"),
        DistributionAnomaly("breaks", column="quantity", approximate=False, bands=("x",)),
    ]
    return _outcomes(spark, fused.checks(_orders(spark, folder), rules, "silver_orders"))


def rule_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Up to 20 distinct failing values of a list and of a reference, in order."""
    rules = [AcceptedValues("currency_known", column="currency", values=schemas.CURRENCIES), ReferentialIntegrity("customer_known", child_column="customer_id", parent_table="silver_customers", parent_column="customer_id")]
    results = fused.checks(_orders(spark, folder), rules, parents={"silver_customers": read_table(spark, folder, "silver_customers")})
    rows = [(r.rule_id, v) for r, key in zip(results, ("invalid_values_sample", "invalid_fk_sample"), strict=True) for v in r.metadata[key]]
    return spark.createDataFrame(rows, "rule_id string, value string")


def rule_distribution_approximate(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate percentiles of line prices, each with whether its rank is off by at most 1 %."""
    lines = read_table(spark, folder, "lineitem")
    rule = DistributionAnomaly("price_distribution", column="l_extendedprice")
    s = fused.check(lines, rule).metadata["current_stats"]
    below = lines.agg(*[F.avg((F.col("l_extendedprice") <= s[f"p{round(b * 100)}"]).cast("double")).alias(f"b{i}") for i, b in enumerate(rule.bands)]).first()
    return spark.createDataFrame([(f"p{round(b * 100)}", abs(below[i] - b) <= 0.01) for i, b in enumerate(rule.bands)], "band string, within_error boolean")


def engine_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The engine over three layers: rules, passed, failed, critical failures, warnings, quarantine."""
    engine = pipeline.Engine(spark)
    jail = quarantine.QuarantineStore(TableStore(spark, _scratch(spark)))
    found = []
    for layer, results in (
        ("bronze", engine.validate_bronze(_raw(spark, folder))),
        ("silver", engine.validate_silver(_orders(spark, folder), reference_time=NOW)),
        ("gold", engine.validate_gold(read_table(spark, folder, "gold_daily_revenue"), reference_time=NOW)),
    ):
        s = engine.summary(results)
        found.append((layer, s["total_rules"], s["passed"], s["failed"], round(s["pass_rate"], 4), len(engine.critical_failures(results)), len(engine.warnings(results)), jail.should_quarantine(results), {r.metadata["run_id"] for r in results} == {engine.run_id}))
    return spark.createDataFrame(found, "layer string, total_rules int, passed int, failed int, pass_rate double, critical_failures int, warnings int, should_quarantine boolean, same_run boolean")


def violations_per_row(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that break row rules, with the ids of the rules."""
    rules = [r for r in rulesets.bronze_rules() if type(r) in (NotNull, AcceptedValues, PositiveNumeric)]
    marked = fused.violations_per_row(_raw(spark, folder), rules)
    return marked.where(F.size("violated_rules") > 0).select("order_id", F.array_join("violated_rules", ",").alias("violated_rules"))


def contract_quality(spark: SparkSession, folder: str) -> DataFrame:
    q = contracts.check_quality(_orders(spark, folder), schemas.contract("silver_orders"))
    rows = [(f"not_null:{c}", x["actual"], x["min_required"], x["passed"]) for c, x in q["not_null_rates"].items()]
    rows.append(("duplicate_rate", q["duplicate_rate"]["actual"], q["duplicate_rate"]["max_allowed"], q["duplicate_rate"]["passed"]))
    rows.append(("row_count", float(q["row_count"]["actual"]), float(q["row_count"]["min_required"]), q["row_count"]["passed"]))
    return spark.createDataFrame(rows, "check_name string, actual double, bound double, passed boolean")


def contract_report(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of the Silver contract, and whether all hold."""
    report = contracts.enforce(_orders(spark, folder), schemas.contract("silver_orders"), NOW)
    rows = [("schema", report["schema"]["passed"]), ("quality", report["quality"]["overall_passed"]), ("freshness", report["freshness"]["passed"]), ("overall", report["overall_passed"])]
    return spark.createDataFrame(rows, "part string, passed boolean")


def contract_schema(spark: SparkSession, folder: str) -> DataFrame:
    found = contracts.check_schema(_orders(spark, folder), schemas.contract("gold_daily_revenue"))
    rows = [("missing", c) for c in found["missing_columns"]] + [("extra", c) for c in found["extra_columns"]] + [("type", c) for c in found["type_mismatches"]]
    return spark.createDataFrame(rows, "finding string, column_name string")


def bronze_projection(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.bronze(_orders(spark, folder), "run-1", NOW).withColumn("_ingestion_timestamp", F.date_format("_ingestion_timestamp", "yyyy-MM-dd HH:mm:ss"))


def _silver(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.silver_orders(_raw(spark, folder), NOW)


def silver_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _silver(spark, folder).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("order_timestamp", "ingestion_timestamp")})


def silver_rejections(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that Silver refuses, with the reasons, as the quarantine sums them up."""
    _, refused = medallion.split_silver(_raw(spark, folder))
    return refused.groupBy(F.col("_reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("record_count"))


def silver_customers(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.silver_customers(_orders(spark, folder), NOW).drop("last_updated")


def silver_products(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.silver_products(_orders(spark, folder), NOW).drop("last_updated")


def gold_daily_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.gold_daily_revenue(_orders(spark, folder), NOW).drop("computed_at")


def gold_product_performance(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.gold_product_performance(_orders(spark, folder), at=NOW).drop("computed_at", "product_name")


def gold_customer_ltv(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.gold_customer_ltv(_orders(spark, folder), NOW).drop("computed_at")


def _scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all machines share."""
    return f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


def silver_without_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Orders left after those that break a strict rule were taken out."""
    failed = quarantine.failed_records(fused.checks(_orders(spark, folder), rulesets.strict_silver_rules(), "silver_orders"))
    return medallion.split_orphans(_orders(spark, folder), failed).select("order_id", "quantity", "currency", "source_file")


def quarantine_table(spark: SparkSession, folder: str) -> DataFrame:
    """What Silver refuses, written to and read from its quarantine table."""
    _, refused = medallion.split_silver(_raw(spark, folder))
    jail = quarantine.QuarantineStore(TableStore(spark, _scratch(spark)))
    jail.quarantine(refused, "silver", "run-1", "bronze_raw_events", at=NOW)
    return jail.store.read("quarantine_silver").withColumn("_quarantine_timestamp", F.date_format("_quarantine_timestamp", "yyyy-MM-dd HH:mm:ss"))


def quarantine_capped(spark: SparkSession, folder: str) -> DataFrame:
    """A quarantine that keeps at most 50 rows tells how many it left out."""
    _, refused = medallion.split_silver(_raw(spark, folder))
    jail = quarantine.QuarantineStore(TableStore(spark, _scratch(spark)), max_records=50)
    kept = jail.quarantine(refused, "silver", "run-1", "bronze_raw_events", at=NOW)
    return spark.createDataFrame([(kept, jail.left_out, jail.store.read("quarantine_silver").count(), jail.over_limit(kept + jail.left_out, 1000))], "kept bigint, left_out bigint, rows_read bigint, over_limit boolean")


def store_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A table overwritten, then appended to with a new column; both versions as they read."""
    store, orders = TableStore(spark, _scratch(spark)), _orders(spark, folder)
    first = store.write(orders.select("order_id"), "t")
    store.write(orders.select("order_id", "quantity"), "t", merge_schema=True)
    second = store.write(orders.where("quantity > 5").select("order_id", F.col("currency").alias("extra")), "t", mode="append", merge_schema=True)
    old = store.read("t", first).select(F.lit(first).alias("version"), "order_id", F.lit(None).cast("int").alias("quantity"), F.lit(None).cast("string").alias("extra"))
    return old.unionByName(store.read("t", second).withColumn("version", F.lit(second)))


def store_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Products replaced and added by key."""
    store, parts = TableStore(spark, _scratch(spark)), read_table(spark, folder, "part")
    store.write(parts.where("p_partkey % 3 <> 0").select("p_partkey", "p_name"), "parts")
    store.upsert(parts.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("p_name")), "parts", ["p_partkey"])
    return store.read("parts")


def layer_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Where the tables of all layers lie under a base folder."""
    rows = [(layer, table, path) for layer in LAYERS for table, path in layer_paths(layer, "/base/").items()]
    return spark.createDataFrame(rows, "layer string, table_name string, path string")


def pipeline_gold_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The whole pipeline over the orders as raw events: revenue per day and currency in Gold."""
    store = TableStore(spark, _scratch(spark))
    report = pipeline.run_pipeline(spark, pipeline.PipelineConfig(store.root, run_at=NOW), _raw(spark, folder))
    if any(r["status"] != "SUCCESS" for r in report["layers"].values()):
        raise RuntimeError(str(report["layers"]))
    return store.read("gold_daily_revenue").drop("computed_at")


def quarantine_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Critical failures of strict rules, united by row and summed up as a quarantine table."""
    results = fused.checks(_orders(spark, folder), rulesets.strict_silver_rules(), "silver_orders")
    failed = quarantine.failed_records(results)
    marked = failed.select(F.lit("silver_orders").alias("_quarantine_dataset"), F.col("_reasons").alias("_quarantine_reasons"), F.col("ingestion_timestamp").alias("_quarantine_timestamp"), F.lit("run-1").alias("_quarantine_run_id"))
    return quarantine.quarantine_summary(marked).withColumnsRenamed({"_quarantine_dataset": "dataset_name", "_quarantine_reasons": "reasons"})


def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    results = fused.checks(_orders(spark, folder), rulesets.silver_rules(), "silver_orders", Context(reference_time=NOW))
    rows = metrics.metric_rows(spark, results, "run-1", "orders", NOW)
    inexact = "(mean|stddev|skewness|kurtosis|p[0-9]+)"  # by order of summation, or approximate
    return _timeless(rows.where(~F.rlike("metric_name", F.lit(f"stat_{inexact}:"))))


def _timeless(rows: DataFrame) -> DataFrame:
    """Metrics without the elapsed time and the metadata, statistics to six places."""
    return rows.where("metric_name <> 'execution_time_ms'").drop("metadata_json", "run_date").withColumns({"metric_value": F.round("metric_value", 6), "run_timestamp": F.date_format("run_timestamp", "yyyy-MM-dd HH:mm:ss")})


def metrics_history(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs written to the metrics table; the later one as its history reads by dataset, layer and rule."""
    kept = metrics.MetricsStore(TableStore(spark, _scratch(spark)))
    rules = [r for r in rulesets.bronze_rules() if type(r) in (NotNull, AcceptedValues, PositiveNumeric)]
    for run, day in (("run-1", 14), ("run-2", 15)):
        kept.write(fused.checks(_raw(spark, folder), rules, "bronze_raw_events"), run, "orders", datetime(2024, 12, day, tzinfo=timezone.utc))
    kept.drop_before("2024-12-15")
    return _timeless(kept.read("bronze_raw_events", "bronze", "bronze_currency_valid"))


def metric_trend(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.metric_trend(read_table(spark, folder, "metrics"), "failure_rate", "silver_orders")


def _sql(spark: SparkSession, folder: str, text: str, *tables: str) -> DataFrame:
    sqlchecks.register_views({t: read_table(spark, folder, t) for t in tables})
    return spark.sql(text)


def sql_referential_integrity(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, sqlchecks.referential_integrity_sql("silver_orders", "product_id", "silver_products", "product_id"), "silver_orders", "silver_products")


def sql_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, sqlchecks.uniqueness_sql("lineitem", ["l_orderkey", "l_linenumber"]), "lineitem")


def sql_accepted_values(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, sqlchecks.accepted_values_sql("silver_orders", "order_status", list(schemas.STATUSES)), "silver_orders")


def sql_not_null(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, sqlchecks.not_null_sql("silver_orders", "customer_id"), "silver_orders")


def sql_freshness(spark: SparkSession, folder: str) -> DataFrame:
    text = sqlchecks.freshness_sql("events", "ts", 24.0, "2024-02-01 00:00:00 UTC")
    return _sql(spark, folder, text, "events").select("age_hours", "sla_hours", "status")


def sql_row_count_trend(spark: SparkSession, folder: str) -> DataFrame:
    """The trend over the row counts that the metrics imply."""
    counts = read_table(spark, folder, "metrics").where("run_id is not null and dataset_name is not null").groupBy("run_id", "dataset_name").agg(F.max("run_timestamp").alias("run_timestamp"), F.max("total_records").cast("double").alias("metric_value"))
    sqlchecks.register_views({"row_counts": counts.withColumn("metric_name", F.lit("row_count"))})
    return spark.sql(sqlchecks.row_count_trend_sql("row_counts", "silver_orders"))


def sql_all_checks(spark: SparkSession, folder: str) -> DataFrame:
    """All kinds of SQL checks at once, one of a statement that fails."""
    tables = ("silver_orders", "silver_customers", "lineitem", "orders")
    sqlchecks.register_views({t: read_table(spark, folder, t) for t in tables})
    checks = {
        "orders_of_unknown_customers": sqlchecks.referential_integrity_sql("silver_orders", "customer_id", "silver_customers", "customer_id"),
        "lines_unique": sqlchecks.uniqueness_sql("lineitem", ["l_orderkey", "l_linenumber"]),
        "orders_unique": sqlchecks.uniqueness_sql("orders", ["o_orderkey"]),
        "status_known": sqlchecks.accepted_values_sql("silver_orders", "order_status", list(schemas.STATUSES)),
        "order_there": ("not_null", sqlchecks.not_null_sql("orders", "o_orderkey")),
        "orders_fresh": ("freshness", sqlchecks.freshness_sql("silver_orders", "ingestion_timestamp", 24.0, "2024-12-16 00:00:00 UTC")),
        "broken": "SELECT nothing FROM nowhere",
    }
    return spark.createDataFrame([(name, passed) for name, (passed, _) in sqlchecks.run_all_checks(spark, checks).items()], "check_name string, passed boolean")


def sql_quality_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, sqlchecks.quality_dashboard_sql("metrics"), "metrics")


def generated_events(spark: SparkSession, folder: str) -> DataFrame:
    return synth.clean_events(spark, 10_000)


def generated_faults(spark: SparkSession, folder: str) -> DataFrame:
    return synth.inject(synth.clean_events(spark, 10_000))


def generated_reference(spark: SparkSession, folder: str) -> DataFrame:
    """The generator's products and customers."""
    products = synth.products(spark).select("product_id", "product_name", "list_price", F.lit(None).cast("string").alias("customer_id"))
    customers = synth.customers(spark).select(F.lit(None).cast("string").alias("product_id"), F.lit(None).cast("string").alias("product_name"), F.lit(None).cast("double").alias("list_price"), "customer_id")
    return products.unionByName(customers)


def generated_drift(spark: SparkSession, folder: str) -> DataFrame:
    """The changes between the four drifting batches."""
    from weir.operators.rules import compare_schemas

    batches = synth.drift_batches(spark)
    rows = []
    for version, df in batches.items():
        diff = compare_schemas(batches["v1"].schema, df.schema)
        rows += [(version, kind, c) for kind in ("added_columns", "removed_columns", "type_changes") for c in diff[kind]]
    return spark.createDataFrame(rows, "version string, change string, column_name string")


QUERIES = {
    f.__name__: f
    for f in (
        rule_not_null, rule_unique_key, rule_unique_key_failures, rule_accepted_values, rule_positive_numeric, rule_freshness, rule_duplicates, op_deduplicate, op_surplus, rules_silver, rules_gold, rule_outcomes, rule_samples, rule_distribution_approximate, engine_summary,
        rule_schema_drift, rule_referential_integrity, rule_row_count_anomaly, rule_distribution_stats, rule_distribution_drift, rules_bronze, violations_per_row,
        contract_quality, contract_schema, contract_report, bronze_projection, silver_orders, silver_rejections, silver_customers, silver_products,
        gold_daily_revenue, gold_product_performance, gold_customer_ltv, quarantine_summary, quarantine_table, quarantine_capped, silver_without_rejected, store_versions, store_upsert, layer_tables, pipeline_gold_daily, metrics_long, metrics_history, metric_trend,
        sql_referential_integrity, sql_uniqueness, sql_accepted_values, sql_not_null, sql_freshness, sql_row_count_trend, sql_quality_dashboard, sql_all_checks,
        generated_events, generated_faults, generated_drift, generated_reference,
    )
}
