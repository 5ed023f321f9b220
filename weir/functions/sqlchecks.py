"""SQL text for checks, one statement each. Names are quoted, values escaped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def name(identifier: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in identifier.split("."))


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def referential_integrity_sql(child: str, child_column: str, parent: str, parent_column: str) -> str:
    c, p = f"c.{name(child_column)}", f"p.{name(parent_column)}"
    return f"SELECT {c}, count(*) AS orphan_count FROM {name(child)} c LEFT ANTI JOIN {name(parent)} p ON {c} = {p} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY orphan_count DESC, {c}"


def uniqueness_sql(table: str, columns: list[str], limit: int = 100) -> str:
    keys = ", ".join(name(c) for c in columns)
    return f"SELECT {keys}, count(*) AS occurrence_count FROM {name(table)} GROUP BY {keys} HAVING count(*) > 1 ORDER BY occurrence_count DESC, {keys} LIMIT {int(limit)}"


def accepted_values_sql(table: str, column: str, values: list[str]) -> str:
    c, listed = name(column), ", ".join(literal(v.lower()) for v in values)
    return f"SELECT {c}, count(*) AS violation_count FROM {name(table)} WHERE {c} IS NOT NULL AND lower({c}) NOT IN ({listed}) GROUP BY {c} ORDER BY violation_count DESC, {c}"


def not_null_sql(table: str, column: str) -> str:
    nulls = f"count_if({name(column)} IS NULL)"
    return f"SELECT {literal(column)} AS column_name, count(*) AS total_records, {nulls} AS null_count, round(try_divide({nulls} * 100.0D, count(*)), 2) AS null_percentage FROM {name(table)}"


def freshness_sql(table: str, column: str, max_age_hours: float = 24.0, now: str | None = None) -> str:
    """``now`` is a timestamp text; left out it is the time of the query."""
    at = f"timestamp {literal(now)}" if now else "current_timestamp()"
    latest = f"max(CAST({name(column)} AS timestamp))"
    age = f"(unix_micros({at}) - unix_micros({latest})) / 3.6e9D"
    return f"SELECT {latest} AS latest_record, {at} AS check_time, round({age}, 2) AS age_hours, {float(max_age_hours)}D AS sla_hours, CASE WHEN {age} <= {float(max_age_hours)}D THEN 'PASS' ELSE 'FAIL - SLA BREACH' END AS status FROM {name(table)}"


def row_count_trend_sql(metrics: str, dataset: str | None = None, limit: int = 30) -> str:
    also = f" AND dataset_name = {literal(dataset)}" if dataset else ""
    return f"""WITH counts AS (
  SELECT run_timestamp, dataset_name, metric_value AS row_count, lag(metric_value) OVER (PARTITION BY dataset_name ORDER BY run_timestamp, metric_value) AS prev_count
  FROM {name(metrics)} WHERE metric_name = 'row_count'{also}
)
SELECT *, round((row_count - prev_count) / nullif(prev_count, 0) * 100, 2) AS pct_change FROM counts ORDER BY run_timestamp DESC, dataset_name, row_count LIMIT {int(limit)}"""


def quality_dashboard_sql(metrics: str) -> str:
    return f"""WITH latest AS (SELECT dataset_name, max_by(run_id, struct(run_timestamp, run_id)) AS run_id FROM {name(metrics)} GROUP BY dataset_name)
SELECT m.dataset_name, m.layer, m.rule_name, m.metric_name, round(m.metric_value, 4) AS metric_value, m.passed, m.severity, m.total_records, m.failed_records, m.run_timestamp
FROM {name(metrics)} m JOIN latest l ON m.dataset_name = l.dataset_name AND m.run_id = l.run_id
WHERE m.metric_name IN ('failure_rate', 'pass_rate', 'null_rate', 'freshness_lag_hours', 'distribution_z_score', 'row_count_delta_pct')
ORDER BY m.layer, m.dataset_name, CASE WHEN m.passed = false THEN 0 ELSE 1 END, m.rule_name"""


def register_views(tables: dict[str, DataFrame]) -> None:
    for view, df in tables.items():
        df.createOrReplaceTempView(view)


#: How each kind of check tells success: no rows, or what its one row says.
PASSES: dict[str, Callable[[DataFrame], bool]] = {
    "no_rows": lambda df: df.isEmpty(),
    "not_null": lambda df: df.first()["null_count"] == 0,
    "freshness": lambda df: df.first()["status"] == "PASS",
}


def run_all_checks(spark: SparkSession, checks: dict[str, str | tuple[str, str]]) -> dict[str, tuple[bool | None, DataFrame | None]]:
    """name -> (passed, result); a check is SQL that must give no rows, or (kind, SQL) with a kind of
    PASSES. A statement that fails gives (None, None)."""
    out: dict[str, tuple[bool | None, DataFrame | None]] = {}
    for check, given in checks.items():
        kind, text = given if isinstance(given, tuple) else ("no_rows", given)
        try:
            df = spark.sql(text)
            out[check] = PASSES[kind](df), df
        except PySparkException:
            out[check] = None, None
    return out
