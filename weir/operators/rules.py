"""The ten rules: what each adds to a fused plan, how it judges the numbers, which rows fail it.

``scan`` gives aggregate expressions over all rows, ``keys``
the key lists it needs counted, ``parents`` the join it needs; ``judge`` reads the numbers. The planner
(``weir.plans.fused``) puts the parts of a whole rule set into one scan, one grouping per key list and
one anti join per reference.
"""

from __future__ import annotations

import json
import math
import re
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, FloatType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from weir.model import AcceptedValues, CheckResult, DistributionAnomaly, Duplicates, Freshness, NotNull, PositiveNumeric, ReferentialIntegrity, RowCountAnomaly, Rule, SchemaDrift, UniqueKey
from weir.operators.ordering import exact_quantiles

SAMPLE = 20
#: Accepted values beyond this number are joined instead of listed in the plan.
LIST_LIMIT = 1000


class Context:
    """What rules are given besides the data."""

    def __init__(self, parents: dict[str, DataFrame] | None = None, historical_counts: list[int] | None = None, historical_stats: dict[str, dict] | None = None, reference_time: datetime | None = None, references: dict[str, DataFrame] | None = None) -> None:
        self.parents, self.references = parents or {}, references or {}
        self.historical_counts, self.historical_stats = historical_counts, historical_stats or {}
        self.reference_time = reference_time or datetime.now(timezone.utc)


class Evaluator:
    """The parts of a rule. Subclasses override what they need."""

    def problem(self, df: DataFrame, rule: Any, context: Context) -> dict | None:
        """Why the rule cannot run on ``df``, or None."""
        return None

    def scan(self, df: DataFrame, rule: Any, context: Context) -> dict[str, Column]:
        return {}

    def keys(self, rule: Any) -> tuple[str, ...] | None:
        return None

    def join(self, df: DataFrame, rule: Any, context: Context) -> DataFrame | None:
        """A frame whose rows fail, to be counted; None if the scan suffices."""
        return None

    def separate(self, df: DataFrame, rule: Any, context: Context) -> dict[str, Any]:
        """Numbers that no single aggregation gives; the only part that may run jobs of its own."""
        return {}

    def judge(self, rule: Any, total: int, found: dict[str, Any], context: Context) -> tuple[bool, int, dict]:
        raise NotImplementedError

    def failing(self, df: DataFrame, rule: Any, context: Context) -> DataFrame | None:
        return None

    def sample(self, df: DataFrame, rule: Any, context: Context) -> tuple[str, DataFrame] | None:
        """Metadata key and a frame of one column of failing values, for failed rules only."""
        return None


def _missing(df: DataFrame, *columns: str) -> dict | None:
    lost = [c for c in columns if c not in df.columns]
    return {"error": f"columns not found: {', '.join(lost)}", "available_columns": df.columns} if lost else None


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class NotNullEvaluator(Evaluator):
    def problem(self, df, rule: NotNull, context):
        return _missing(df, rule.column)

    def scan(self, df, rule: NotNull, context):
        return {"nulls": F.count_if(column(rule.column).isNull())}

    def judge(self, rule: NotNull, total, found, context):
        n = found["nulls"]
        return n == 0, n, {"column_name": rule.column, "null_count": n, "null_rate": n / total if total else 0.0}

    def failing(self, df, rule: NotNull, context):
        return df.where(column(rule.column).isNull())


class UniqueKeyEvaluator(Evaluator):
    """Null keys are keys like others, equal to each other. All rows of a repeated key fail."""

    def problem(self, df, rule: UniqueKey, context):
        return _missing(df, *rule.columns)

    def keys(self, rule: UniqueKey):
        return rule.columns

    def judge(self, rule: UniqueKey, total, found, context):
        meta = {"key_columns": list(rule.columns), "duplicate_groups": found["groups"], "total_duplicate_records": found["records"], "excess_records": found["excess"]}
        return found["groups"] == 0, found["excess"], meta

    def failing(self, df, rule: UniqueKey, context):
        keys = [column(c) for c in rule.columns]
        repeated = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).count().where("count > 1")
        on = [k.eqNullSafe(repeated[f"_k{i}"]) for i, k in enumerate(keys)]
        return df.join(repeated, on, "left_semi")


def _outside(rule: AcceptedValues) -> Column:
    value = column(rule.column).cast("string")
    listed = list(rule.values) if rule.case_sensitive else sorted({v.lower() for v in rule.values})
    return value.isNotNull() & ~(value if rule.case_sensitive else F.lower(value)).isin(listed)


class AcceptedValuesEvaluator(Evaluator):
    """Null is no violation. A reference table, which the context must hold, adds its first column."""

    def problem(self, df, rule: AcceptedValues, context):
        lost = _missing(df, rule.column)
        if lost is None and rule.reference_table and rule.reference_table not in context.references:
            return {"error": f"reference table not given: {rule.reference_table}"}
        return lost

    def by_join(self, rule: AcceptedValues, context: Context) -> bool:
        return rule.reference_table in context.references or len(rule.values) > LIST_LIMIT

    def scan(self, df, rule: AcceptedValues, context):
        return {} if self.by_join(rule, context) else {"outside": F.count_if(_outside(rule))}

    def join(self, df, rule: AcceptedValues, context):
        return self.failing(df, rule, context) if self.by_join(rule, context) else None

    def judge(self, rule: AcceptedValues, total, found, context):
        n = found["joined"] if "joined" in found else found["outside"]
        values = list(rule.values) if rule.case_sensitive else [v.lower() for v in rule.values]
        return n == 0, n, {"column_name": rule.column, "accepted_values": values, "case_sensitive": rule.case_sensitive}

    def failing(self, df, rule: AcceptedValues, context):
        if not self.by_join(rule, context):
            return df.where(_outside(rule))
        value = column(rule.column).cast("string")
        allowed = self.allowed(df, rule, context)
        return df.where(value.isNotNull()).join(allowed, (value if rule.case_sensitive else F.lower(value)) == F.col("_v"), "left_anti")

    def allowed(self, df: DataFrame, rule: AcceptedValues, context: Context) -> DataFrame:
        """(_v), the accepted values, each once, in lower case unless case counts."""
        spark, fold = df.sparkSession, (lambda c: c) if rule.case_sensitive else F.lower
        allowed = spark.createDataFrame([(v,) for v in rule.values], "_v string")
        if rule.reference_table in context.references:
            reference = context.references[rule.reference_table]
            allowed = allowed.unionByName(reference.select(reference[reference.columns[0]].cast("string").alias("_v")))
        return allowed.where("_v is not null").select(fold(F.col("_v")).alias("_v")).distinct()

    def sample(self, df, rule: AcceptedValues, context):
        return "invalid_values_sample", self.failing(df, rule, context).select(column(rule.column).cast("string").alias("v"))


def _is_nan(df: DataFrame, name: str) -> Column:
    return F.isnan(column(name)) if isinstance(df.schema[name].dataType, (DoubleType, FloatType)) else F.lit(False)


class PositiveNumericEvaluator(Evaluator):
    """Null is no violation, not-a-number is one; it does not enter min, max and mean."""

    def problem(self, df, rule: PositiveNumeric, context):
        lost = _missing(df, rule.column)
        if lost is None and not isinstance(df.schema[rule.column].dataType, NumericType):
            return {"error": f"column is not numeric: {rule.column} is {df.schema[rule.column].dataType.simpleString()}"}
        return lost

    def _low(self, df: DataFrame, rule: PositiveNumeric) -> Column:
        value = column(rule.column)
        return F.coalesce(((value < 0) if rule.allow_zero else (value <= 0)) & ~_is_nan(df, rule.column), F.lit(False))

    def scan(self, df, rule: PositiveNumeric, context):
        low, value = self._low(df, rule), column(rule.column).cast("double")
        bad = F.when(low, value)
        return {"low": F.count_if(low), "nan": F.count_if(_is_nan(df, rule.column)), "least": F.min(bad), "most": F.max(bad), "mean": F.avg(bad)}

    def judge(self, rule: PositiveNumeric, total, found, context):
        n = found["low"] + found["nan"]
        meta = {"column_name": rule.column, "allow_zero": rule.allow_zero, "negative_count": found["low"], "nan_count": found["nan"]}
        if n:
            meta |= {"min_failing_value": found["least"], "max_failing_value": found["most"], "avg_failing_value": found["mean"]}
        return n == 0, n, meta

    def failing(self, df, rule: PositiveNumeric, context):
        return df.where(self._low(df, rule) | _is_nan(df, rule.column))


def as_utc(kind: DataType, value: Column) -> Column:
    """A point of time as microseconds since 1970 in UTC; text that is none gives null."""
    if not isinstance(kind, TimestampType):
        value = F.convert_timezone(F.lit("UTC"), F.current_timezone(), value.try_cast("timestamp_ntz")).cast("timestamp")
    return F.unix_micros(value)


class FreshnessEvaluator(Evaluator):
    """The latest time must not be older than allowed. Empty, all null or unreadable fails; a latest
    time in the future passes and is flagged. Times without zone count as UTC."""

    def problem(self, df, rule: Freshness, context):
        lost = _missing(df, rule.column)
        if lost is None and not isinstance(df.schema[rule.column].dataType, (StringType, TimestampType, TimestampNTZType, DateType)):
            return {"error": f"column holds no time: {rule.column} is {df.schema[rule.column].dataType.simpleString()}"}
        return lost

    def scan(self, df, rule: Freshness, context):
        return {"latest": F.max(as_utc(df.schema[rule.column].dataType, column(rule.column)))}

    def judge(self, rule: Freshness, total, found, context):
        latest, now = found["latest"], context.reference_time
        now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
        meta: dict[str, Any] = {"column_name": rule.column, "sla_hours": rule.max_age_hours, "reference_time": now.isoformat()}
        if latest is None:
            return False, total, meta | {"error": "no readable time", "max_timestamp": None}
        age = (now.timestamp() * 1e6 - latest) / 3.6e9
        late = age > rule.max_age_hours
        meta |= {"max_timestamp": datetime.fromtimestamp(latest / 1e6, timezone.utc).isoformat(), "age_hours": round(age, 2), "breach_hours": round(max(0.0, age - rule.max_age_hours), 2), "in_future": age < 0}
        return not late, total if late else 0, meta


def keep_order(df: DataFrame, rule: Duplicates) -> list[Column]:
    """A total order of rows: the order column first (nulls last), then every orderable column."""
    first = []
    if rule.order_by:
        first = [column(rule.order_by).desc_nulls_last() if rule.keep == "last" else column(rule.order_by).asc_nulls_last()]
    rest = [F.to_json(column(f.name)) if f.dataType.typeName() == "map" else column(f.name) for f in df.schema.fields if f.dataType.typeName() != "variant"]
    return first + [c.asc_nulls_last() for c in (*rest, *_zero_signs(df).values())]


def _zero_signs(df: DataFrame) -> dict[str, Column]:
    """Per column of floating numbers what tells -0.0 from 0.0, which compare and group as one value."""
    signs = {}
    for f in df.schema.fields:
        c = column(f.name)
        if f.dataType.typeName() in ("double", "float"):
            signs[f.name] = F.when(c == 0, c.cast("string") == "-0.0").otherwise(False)
        elif f.dataType.typeName() in ("array", "struct") and re.search('"(double|float)"', f.dataType.json()):
            signs[f.name] = c.cast("string")
    return signs


def deduplicate(df: DataFrame, rule: Duplicates) -> DataFrame:
    """One row per key: the last or first by the order column, ties settled by the whole row."""
    w = Window.partitionBy(*[column(c) for c in rule.key_columns]).orderBy(*keep_order(df, rule))
    return df.withColumn("_weir_rn", F.row_number().over(w)).where("_weir_rn = 1").drop("_weir_rn")


def surplus(df: DataFrame, rule: Duplicates) -> DataFrame:
    """The rows that ``deduplicate`` leaves out, each as often as it is surplus.

    Like rows are counted first, the kept row of each key is found by aggregation, and the two meet in a
    join, so a key that a third of all rows share (null keys are one) is never sorted in one task. Grouping
    makes -0.0 to 0.0; the values come back as they were, and of such rows 0.0 is kept. Tables
    with maps or variants, which cannot be grouped, are ranked by window.
    """
    if any(f.dataType.typeName() in ("map", "variant") for f in df.schema.fields):
        w = Window.partitionBy(*[column(c) for c in rule.key_columns]).orderBy(*keep_order(df, rule))
        return df.withColumn("_weir_rn", F.row_number().over(w)).where("_weir_rn > 1").drop("_weir_rn")
    keys = {f"_weir_k{i}": column(c) for i, c in enumerate(rule.key_columns)}
    signs = {c: (f"_weir_z{i}", f"_weir_v{i}", sign) for i, (c, sign) in enumerate(_zero_signs(df).items())}
    counted = df.groupBy(*[column(c) for c in df.columns], *[sign.alias(z) for z, _, sign in signs.values()]).agg(F.count(F.lit(1)).alias("_weir_n"), *[F.first(column(c)).alias(v) for c, (_, v, _) in signs.items()])
    rest = F.struct(*[x for c in (*map(column, df.columns), *[F.col(z) for z, _, _ in signs.values()]) for x in (c.isNull(), c)])  # nulls last

    def meet(side: DataFrame) -> DataFrame:
        on = None
        for k, c in keys.items():
            same = c.eqNullSafe(F.col(k))
            on = same if on is None else on & same
        return counted.join(side, on)

    best = counted
    if rule.order_by:
        order = column(rule.order_by)
        tops = counted.groupBy(*[c.alias(k) for k, c in keys.items()]).agg((F.max if rule.keep == "last" else F.min)(order).alias("_weir_top"))
        best = meet(tops).where(order.eqNullSafe(F.col("_weir_top")))
    kept = best.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.min(rest).alias("_weir_kept"))
    left = meet(kept).withColumn("_weir_n", F.col("_weir_n") - F.when(rest == F.col("_weir_kept"), 1).otherwise(0)).where("_weir_n > 0")
    return left.select(*[F.col(signs[c][1]).alias(c) if c in signs else column(c) for c in df.columns], F.explode(F.sequence(F.lit(1).cast("bigint"), "_weir_n")).alias("_weir_copy")).drop("_weir_copy")


class DuplicatesEvaluator(Evaluator):
    def problem(self, df, rule: Duplicates, context):
        return _missing(df, *rule.key_columns, *([rule.order_by] if rule.order_by else []))

    def keys(self, rule: Duplicates):
        return rule.key_columns

    def judge(self, rule: Duplicates, total, found, context):
        n = found["excess"]
        ratio = round((total - n) / total, 4) if total else 1.0
        return n == 0, n, {"key_columns": list(rule.key_columns), "order_by": rule.order_by, "keep_strategy": rule.keep, "duplicate_records_found": n, "unique_records": total - n, "dedup_ratio": ratio}

    def failing(self, df, rule: Duplicates, context):
        return surplus(df, rule)


def compare_schemas(expected: StructType, actual: StructType) -> dict[str, Any]:
    """Columns added, removed and of another type."""
    want, have = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (expected, actual))
    changed = {c: {"expected": want[c], "actual": have[c]} for c in sorted(want.keys() & have.keys()) if want[c] != have[c]}
    added, removed = sorted(have.keys() - want.keys()), sorted(want.keys() - have.keys())
    return {"added_columns": added, "removed_columns": removed, "type_changes": changed, "has_drift": bool(added or removed or changed)}


class SchemaDriftEvaluator(Evaluator):
    """Compares metadata only; the planner passes the schema, the total comes with the scan."""

    def judge(self, rule: SchemaDrift, total, found, context):
        actual = StructType.fromJson(json.loads(found["_schema"]))
        names, want = set(actual.fieldNames()), set(rule.expected_columns)
        added, removed = sorted(names - want), sorted(want - names)
        types = compare_schemas(rule.expected_schema, actual)["type_changes"] if rule.expected_schema else {}
        reasons = []
        if removed and rule.alert_on_missing:
            reasons.append(f"missing columns: {', '.join(removed)}")
        if added and not rule.allow_extra:
            reasons.append(f"unexpected columns: {', '.join(added)}")
        if types and rule.alert_on_type_change:
            reasons.append(f"changed types: {', '.join(types)}")
        meta = {"expected_columns": sorted(want), "actual_columns": sorted(names), "added_columns": added, "removed_columns": removed, "type_changes": types, "has_drift": bool(reasons), "drift_reasons": reasons, "expected_count": len(want), "actual_count": len(names)}
        return not reasons, total if reasons else 0, meta


class ReferentialIntegrityEvaluator(Evaluator):
    """Null references are no orphans. The anti join needs no distinct parents and no hint: adaptive
    execution broadcasts small parents and splits skewed children."""

    def problem(self, df, rule: ReferentialIntegrity, context):
        parent = context.parents.get(rule.parent_table)
        if parent is None:
            return {"error": f"parent table not given: {rule.parent_table}"}
        return _missing(df, rule.child_column) or _missing(parent, rule.parent_column)

    def join(self, df, rule: ReferentialIntegrity, context):
        return self.failing(df, rule, context)

    def scan(self, df, rule: ReferentialIntegrity, context):
        return {"referring": F.count(column(rule.child_column))}

    def judge(self, rule: ReferentialIntegrity, total, found, context):
        n = found["joined"]
        return n == 0, n, {"child_column": rule.child_column, "parent_table": rule.parent_table, "parent_column": rule.parent_column, "orphan_count": n, "referring_count": found["referring"]}

    def failing(self, df, rule: ReferentialIntegrity, context):
        parent = context.parents[rule.parent_table].select(column(rule.parent_column).alias("_weir_parent"))
        return df.where(column(rule.child_column).isNotNull()).join(parent, column(rule.child_column) == F.col("_weir_parent"), "left_anti")

    def sample(self, df, rule: ReferentialIntegrity, context):
        return "invalid_fk_sample", self.failing(df, rule, context).select(column(rule.child_column).cast("string").alias("v"))


class RowCountAnomalyEvaluator(Evaluator):
    """Deviation from the mean of the last runs; without history the run becomes the baseline."""

    def judge(self, rule: RowCountAnomaly, total, found, context):
        history = [int(x) for x in (context.historical_counts or []) if x is not None][-rule.lookback :]
        meta: dict[str, Any] = {"current_count": total, "lookback_runs": len(history), "thresholds": [rule.min_deviation_pct, rule.max_deviation_pct]}
        if not history:
            return True, 0, meta | {"baseline_established": True}
        mean = sum(history) / len(history)
        spread = math.sqrt(sum((x - mean) ** 2 for x in history) / len(history))
        deviation = (total - mean) / mean * 100 if mean else (100.0 if total else 0.0)
        kind = "count_drop" if deviation < rule.min_deviation_pct else "count_spike" if deviation > rule.max_deviation_pct else None
        meta |= {"baseline_mean": round(mean, 1), "baseline_stddev": round(spread, 1), "baseline_min": min(history), "baseline_max": max(history), "deviation_pct": round(deviation, 2), "is_anomaly": kind is not None, "anomaly_type": kind, "historical_counts": history}
        return kind is None, total if kind else 0, meta


def band_name(p: float) -> str:
    return f"p{round(p * 100)}"


class DistributionAnomalyEvaluator(Evaluator):
    """z of the mean against the history, and drift of percentiles. Nulls and not-a-number are left
    out and the latter counted."""

    def problem(self, df, rule: DistributionAnomaly, context):
        lost = _missing(df, rule.column)
        if lost is None and not isinstance(df.schema[rule.column].dataType, NumericType):
            return {"error": f"column is not numeric: {rule.column}"}
        return lost

    def scan(self, df, rule: DistributionAnomaly, context):
        v = F.when(~_is_nan(df, rule.column), column(rule.column).cast("double"))
        bands = {"bands": F.percentile_approx(v, [float(b) for b in rule.bands], max(1, round(1 / rule.relative_error)))} if rule.approximate else {}
        return {"count": F.count(v), "mean": F.avg(v), "stddev": F.stddev(v), "min": F.min(v), "max": F.max(v), "skewness": F.skewness(v), "kurtosis": F.kurtosis(v), "nan_count": F.count_if(_is_nan(df, rule.column)), **bands}

    def separate(self, df, rule: DistributionAnomaly, context):
        if rule.approximate:
            return {}
        return {"bands": exact_quantiles(df.select(column(rule.column).alias("_v")), "_v", [float(b) for b in rule.bands])}

    @staticmethod
    def statistics(rule: DistributionAnomaly, found: dict) -> dict[str, Any]:
        stats = {k: found[k] for k in ("count", "mean", "stddev", "min", "max", "skewness", "kurtosis", "nan_count")}
        return stats | {band_name(b): q for b, q in zip(rule.bands, found["bands"] or [None] * len(rule.bands), strict=False)}

    def judge(self, rule: DistributionAnomaly, total, found, context):
        now, before = self.statistics(rule, found), context.historical_stats.get(rule.column)
        meta: dict[str, Any] = {"column_name": rule.column, "current_stats": now}
        if now["count"] < rule.min_sample:
            return True, 0, meta | {"note": f"fewer than {rule.min_sample} values"}
        if not before or before.get("mean") is None:
            return True, 0, meta | {"baseline_established": True}
        gap = now["mean"] - before["mean"]
        z = gap / before["stddev"] if before.get("stddev") else (0.0 if gap == 0 else math.copysign(math.inf, gap))
        drift = {}
        for b in rule.bands:
            old, new = before.get(band_name(b)), now[band_name(b)]
            if old is not None and new is not None:
                drift[band_name(b)] = round((new - old) / abs(old) * 100, 2) if old else (0.0 if new == 0 else 100.0)
        worst = max((abs(x) for x in drift.values()), default=0.0)
        off_mean, off_band = abs(z) > rule.z_threshold, worst > rule.max_drift_pct
        anomalies = [x for x, on in ((f"z-score {z:.4g}", off_mean), (f"percentile drift {worst:.4g} %", off_band)) if on]
        meta |= {"historical_stats": before, "z_score": round(z, 4), "percentile_drift": drift, "max_percentile_drift_pct": worst, "z_score_anomaly": off_mean, "percentile_anomaly": off_band, "anomalies": anomalies, "detection_method": "z_score+percentile_drift"}
        return not anomalies, total if anomalies else 0, meta


REGISTRY: dict[type[Rule], Evaluator] = {
    NotNull: NotNullEvaluator(),
    UniqueKey: UniqueKeyEvaluator(),
    AcceptedValues: AcceptedValuesEvaluator(),
    PositiveNumeric: PositiveNumericEvaluator(),
    Freshness: FreshnessEvaluator(),
    Duplicates: DuplicatesEvaluator(),
    SchemaDrift: SchemaDriftEvaluator(),
    ReferentialIntegrity: ReferentialIntegrityEvaluator(),
    RowCountAnomaly: RowCountAnomalyEvaluator(),
    DistributionAnomaly: DistributionAnomalyEvaluator(),
}


def register(kind: type[Rule], evaluator: Evaluator) -> None:
    """Adds a rule type, or replaces one."""
    REGISTRY[kind] = evaluator


def result(rule: Rule, dataset: str, passed: bool, total: int, failed: int, meta: dict, name: str | None = None, severity: str | None = None, skipped: bool = False) -> CheckResult:
    return CheckResult(name or rule.rule_id, passed, total, failed, rule.rule_version, severity or rule.severity.value, rule.layer.value, dataset, skipped, meta)
