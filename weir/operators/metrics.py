"""Results as long-format metrics, and the append-only history of them."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.model import CheckResult
from weir.schemas import schema
from weir.sources.store import TableStore

# Metadata key -> metric name.
METRIC_NAMES = {
    "null_rate": "null_rate",
    "duplicate_groups": "duplicate_groups",
    "dedup_ratio": "dedup_ratio",
    "age_hours": "freshness_lag_hours",
    "deviation_pct": "row_count_delta_pct",
    "current_count": "row_count",
    "z_score": "distribution_z_score",
    "max_percentile_drift_pct": "distribution_drift_pct",
    "has_drift": "schema_drift_detected",
}
#: What stands for an infinite metric, so that averages over the history stay finite.
INFINITE = 1e308


def _finite(value: float) -> float:
    return math.copysign(INFINITE, value) if math.isinf(value) else value


def metric_rows(spark: SparkSession, results: Iterable[CheckResult], run_id: str, pipeline: str = "", at: datetime | None = None) -> DataFrame:
    """One row per result and metric, all of one run with one timestamp. The metadata stands, as
    JSON, with the failure rate. No results give an empty frame."""
    at = at or datetime.now(timezone.utc)
    rows = []
    for r in results:
        def row(name: str, value: float, meta: str | None = None, r: CheckResult = r) -> tuple:
            return (run_id, r.dataset or "unknown", r.layer or "unknown", r.rule_id, r.rule_version, name, _finite(float(value)), r.passed, r.severity, r.total_records, r.failed_records, at, pipeline, meta)

        rows += [row("failure_rate", r.failure_rate, json.dumps(r.metadata, default=str)), row("pass_rate", r.pass_rate), row("execution_time_ms", r.elapsed_ms)]
        rows += [row(name, r.metadata[key]) for key, name in METRIC_NAMES.items() if r.metadata.get(key) is not None]
        stats = r.metadata.get("current_stats")
        if stats and stats.get("count"):
            rows += [row(f"stat_{k}:{r.metadata['column_name']}", v) for k, v in stats.items() if v is not None]
    return spark.createDataFrame(rows, schema("metrics"))


class MetricsStore:
    """The metrics table, partitioned by the day of the run."""

    def __init__(self, store: TableStore, table: str = "metrics") -> None:
        self.store, self.table = store, table
        self.errors: list[str] = []

    def write(self, results: Iterable[CheckResult], run_id: str, pipeline: str = "", at: datetime | None = None) -> int:
        """Appends; returns the rows written. A write that fails is kept in ``errors``, gives 0 and ends no
        run."""
        found = list(results)
        if not found:
            return 0
        try:
            return self._append(found, run_id, pipeline, at)
        except Exception as e:  # noqa: BLE001
            self.errors.append(f"{self.table}: {e}"[:500])
            return 0

    def drop_before(self, day: str) -> int:
        """Retention: rewrites the history without the runs before ``day`` (yyyy-MM-dd); returns how many
        rows left. Old versions stay until the store is vacuumed."""
        if not self.store.exists(self.table):
            return 0
        history = self.store.read(self.table)
        gone = history.where(F.col("run_date") < F.lit(day).cast("date")).count()
        if gone:
            self.store.write(history.where(F.col("run_date") >= F.lit(day).cast("date")), self.table, partition_by=["run_date"])
        return gone

    def _append(self, found: list[CheckResult], run_id: str, pipeline: str, at: datetime | None) -> int:
        rows = metric_rows(self.store.spark, found, run_id, pipeline, at).withColumn("run_date", F.to_date("run_timestamp"))
        self.store.write(rows.coalesce(1), self.table, mode="append", merge_schema=True, partition_by=["run_date"], run_id=run_id)
        return rows.count()

    def read(self, dataset: str | None = None, layer: str | None = None, rule: str | None = None, last_days: int | None = None) -> DataFrame | None:
        """The history, filtered; None if there is none. Days prune partitions."""
        if not self.store.exists(self.table):
            return None
        df = self.store.read(self.table)
        for name, value in (("dataset_name", dataset), ("layer", layer), ("rule_name", rule)):
            if value is not None:
                df = df.where(F.col(name) == value)
        return df if last_days is None else df.where(F.col("run_date") >= F.date_sub(F.current_date(), last_days))

    def trend(self, metric: str, dataset: str, rule: str | None = None, last_runs: int = 10) -> DataFrame | None:
        history = self.read(dataset=dataset, rule=rule)
        return None if history is None else metric_trend(history, metric, dataset, rule, last_runs)

    def row_counts(self, dataset: str, last_runs: int = 10, before_run: str | None = None) -> list[int]:
        """Row counts of the last runs, oldest first, without the run's own."""
        history = self.read(dataset=dataset)
        if history is None:
            return []
        if before_run is not None:
            history = history.where(F.col("run_id") != before_run)
        return recent_row_counts(history, dataset, last_runs)

    def statistics(self, dataset: str, before_run: str | None = None) -> dict[str, dict[str, Any]]:
        """Column -> statistics of the latest run that stored them."""
        history = self.read(dataset=dataset)
        if history is None:
            return {}
        stats = history.where(F.col("metric_name").startswith("stat_"))
        if before_run is not None:
            stats = stats.where(F.col("run_id") != before_run)
        latest = stats.groupBy("metric_name").agg(F.max_by("metric_value", F.struct("run_timestamp", "run_id")).alias("v"))
        out: dict[str, dict[str, Any]] = {}
        for r in latest.collect():  # one row per column and statistic
            key, _, name = r["metric_name"].removeprefix("stat_").partition(":")
            out.setdefault(name, {})[key] = r["v"]
        return out


def recent_row_counts(history: DataFrame, dataset: str, last_runs: int = 10) -> list[int]:
    """The most records that any rule saw in each of the last runs, oldest run first."""
    runs = history.where((F.col("dataset_name") == dataset) & F.col("run_id").isNotNull() & (F.col("total_records") > 0)).groupBy("run_id").agg(F.max("run_timestamp").alias("at"), F.max("total_records").alias("n"))
    return [int(r["n"]) for r in runs.orderBy(F.desc("at"), "run_id").limit(last_runs).collect()][::-1]


def metric_trend(history: DataFrame, metric: str, dataset: str, rule: str | None = None, last_runs: int = 10) -> DataFrame:
    """The last runs' values of a metric, oldest first; ties of time by run and rule."""
    df = history.where((F.col("metric_name") == metric) & (F.col("dataset_name") == dataset))
    if rule is not None:
        df = df.where(F.col("rule_name") == rule)
    columns = ["run_timestamp", "run_id", "rule_name", "metric_value", "passed"]
    order = ["run_timestamp", "run_id", "rule_name", "metric_value"]
    return df.select(*columns).orderBy(*[F.desc(c) for c in order]).limit(last_runs).orderBy(*order)
