"""Data contracts: schema, quality and freshness."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.model import Contract
from weir.operators.rules import as_utc, column, compare_schemas
from weir.plans.fused import key_statistics


def check_schema(df: DataFrame, contract: Contract) -> dict[str, Any]:
    """Missing columns and other types fail; extra columns pass if the contract may evolve.
    Nullability is not compared."""
    diff = compare_schemas(contract.schema, df.schema)
    passed = not diff["removed_columns"] and not diff["type_changes"] and (contract.allow_evolution or not diff["added_columns"])
    return {"passed": passed, "missing_columns": diff["removed_columns"], "extra_columns": diff["added_columns"], "type_mismatches": diff["type_changes"]}


def check_quality(df: DataFrame, contract: Contract) -> dict[str, Any]:
    """Shares of values, rate of repeated keys (groups by rows), row count; one scan and one grouping.

    Columns that ``df`` lacks are skipped; an empty table has full shares and no repeats.
    """
    held = [c for c in contract.min_not_null if c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(column(c).isNull()).alias(f"null_{i}") for i, c in enumerate(held)]).first()
    total = row["n"]
    rates = {}
    for i, c in enumerate(held):
        actual = 1 - row[f"null_{i}"] / total if total else 1.0
        rates[c] = {"min_required": contract.min_not_null[c], "actual": round(actual, 4), "passed": actual >= contract.min_not_null[c]}
    report: dict[str, Any] = {"not_null_rates": rates}
    keys = tuple(c for c in contract.primary_key if c in df.columns)
    if keys:
        rate = key_statistics(df, keys).first()["groups"] / total if total else 0.0
        report["duplicate_rate"] = {"max_allowed": contract.max_duplicate_rate, "actual": round(rate, 4), "passed": rate <= contract.max_duplicate_rate}
    enough = total >= contract.min_rows and (contract.max_rows is None or total <= contract.max_rows)
    report["row_count"] = {"actual": total, "min_required": contract.min_rows, "max_allowed": contract.max_rows, "passed": enough}
    report["overall_passed"] = enough and report.get("duplicate_rate", {}).get("passed", True) and all(x["passed"] for x in rates.values())
    return report


def check_freshness(df: DataFrame, contract: Contract, now: datetime | None = None) -> dict[str, Any]:
    """Age of the latest value of the contract's freshness column; passes where none is declared."""
    name = contract.freshness_column
    if not name or name not in df.columns:
        return {"passed": True, "checked": False}
    now = now or datetime.now(timezone.utc)
    now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    latest = df.agg(F.max(as_utc(df.schema[name].dataType, column(name))).alias("at")).first()["at"]
    age = None if latest is None else (now.timestamp() * 1e6 - latest) / 3.6e9
    return {"passed": age is not None and age <= contract.max_freshness_hours, "checked": True, "age_hours": None if age is None else round(age, 2), "max_allowed": contract.max_freshness_hours}


def enforce(df: DataFrame, contract: Contract, now: datetime | None = None) -> dict[str, Any]:
    """The whole report; a failed part does not keep the others from running."""
    parts = {"schema": check_schema(df, contract), "quality": check_quality(df, contract), "freshness": check_freshness(df, contract, now)}
    passed = parts["schema"]["passed"] and parts["quality"]["overall_passed"] and parts["freshness"]["passed"]
    return {"contract_name": contract.dataset, "contract_version": contract.version, "layer": contract.layer, "overall_passed": passed, **parts}
