"""Rule sets as few jobs: one scan, one grouping per key list, one anti join per reference.

Rules are checked against the schema first; what cannot run gives a failed result and never reaches
the plan. If the fused run still fails, whatever the error, rules run one by one, so one bad rule costs
one result.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.model import CheckResult, Rule
from weir.operators import rules as R


def key_statistics(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: repeated groups, rows in them, rows beyond the first of each. Null keys are equal."""
    counts = df.groupBy(*[R.column(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") > 1
    zero = F.lit(0).cast("bigint")
    return counts.agg(F.count_if(more).alias("groups"), F.coalesce(F.sum(F.when(more, F.col("n"))), zero).alias("records"), F.coalesce(F.sum(F.when(more, F.col("n") - 1)), zero).alias("excess"))


def check(df: DataFrame, rule: Rule, dataset: str = "", context: R.Context | None = None, **given: Any) -> CheckResult:
    """One rule. Disabled, unknown and failing rules give SKIPPED_, UNKNOWN_ and ERROR_ results."""
    return checks(df, [rule], dataset, context, **given)[0]


def checks(df: DataFrame, rules: Iterable[Rule], dataset: str = "", context: R.Context | None = None, samples: bool = True, **given: Any) -> list[CheckResult]:
    """All rules, in their order, from one fused plan. ``given`` builds a context if none is."""
    context = context or R.Context(**given)
    ordered = list(rules)
    done: dict[int, CheckResult] = {}
    planned: list[tuple[int, Rule, R.Evaluator]] = []
    for i, rule in enumerate(ordered):
        kind, evaluator = type(rule).__name__, R.REGISTRY.get(type(rule))
        if not rule.enabled:
            done[i] = R.result(rule, dataset, True, 0, 0, {"reason": "disabled"}, f"SKIPPED_{kind}", skipped=True)
        elif evaluator is None:
            done[i] = R.result(rule, dataset, False, 0, 0, {"error": f"unknown rule type {kind}"}, f"UNKNOWN_{kind}", "warning")
        else:
            try:
                problem = evaluator.problem(df, rule, context)
            except Exception as e:  # noqa: BLE001 a rule's error is its result
                done[i] = _error(rule, dataset, e)
                continue
            if problem:
                done[i] = R.result(rule, dataset, False, 0, 0, problem)
            else:
                planned.append((i, rule, evaluator))
    try:
        done |= _run(df, planned, dataset, context, samples)
    except Exception:  # noqa: BLE001
        for one in planned:
            try:
                done |= _run(df, [one], dataset, context, samples)
            except Exception as e:  # noqa: BLE001
                done[one[0]] = _error(one[1], dataset, e)
    return [done[i] for i in range(len(ordered))]


def _error(rule: Rule, dataset: str, error: Exception) -> CheckResult:
    return R.result(rule, dataset, False, 0, 0, {"error": f"{type(error).__name__}: {error}"[:500]}, f"ERROR_{type(rule).__name__}", "critical")


def scan_plan(df: DataFrame, planned: list[tuple[int, Rule, R.Evaluator]], context: R.Context) -> DataFrame:
    """The fused aggregation: the row count and every rule's expressions."""
    parts = [F.count(F.lit(1)).alias("_total")]
    for i, rule, evaluator in planned:
        parts += [expression.alias(f"r{i}_{name}") for name, expression in evaluator.scan(df, rule, context).items()]
    return df.agg(*parts)


def _run(df: DataFrame, planned: list[tuple[int, Rule, R.Evaluator]], dataset: str, context: R.Context, samples: bool) -> dict[int, CheckResult]:
    if not planned:
        return {}
    began = time.perf_counter()
    row = scan_plan(df, planned, context).first().asDict()
    by_keys = {keys: key_statistics(df, keys).first().asDict() for keys in {e.keys(r) for _, r, e in planned} - {None}}
    counted: dict[int, int] = {}
    apart = {i: evaluator.separate(df, rule, context) for i, rule, evaluator in planned}
    for i, rule, evaluator in planned:
        joined = evaluator.join(df, rule, context)
        if joined is not None:
            counted[i] = joined.count()
    found: dict[int, CheckResult] = {}
    for i, rule, evaluator in planned:
        own = {name.removeprefix(f"r{i}_"): v for name, v in row.items() if name.startswith(f"r{i}_")}
        own |= by_keys.get(evaluator.keys(rule), {}) if evaluator.keys(rule) else {}
        own |= {"joined": counted[i]} if i in counted else {}
        own |= apart[i]
        own["_schema"] = df.schema.json()
        passed, failed, meta = evaluator.judge(rule, row["_total"], own, context)
        out = R.result(rule, dataset, passed, row["_total"], failed, meta)
        if not passed:
            out.failed_df = evaluator.failing(df, rule, context)
            if samples and (drawn := evaluator.sample(df, rule, context)):
                out.metadata[drawn[0]] = [r["v"] for r in drawn[1].distinct().orderBy("v").limit(R.SAMPLE).collect()]
        found[i] = out
    spent = (time.perf_counter() - began) * 1000 / len(planned)
    for out in found.values():
        out.elapsed_ms = spent
    return found


def violations_per_row(df: DataFrame, rules: Iterable[Rule], name: str = "violated_rules", context: R.Context | None = None) -> DataFrame:
    """``df`` with the ids of the row rules (null, list, number) that each row breaks, in one pass. A list
    from a reference table, which the context must hold, or of many values is joined."""
    context, columns = context or R.Context(), df.columns
    marks: list[Column] = []
    for i, rule in enumerate(rules):
        if type(rule) is R.NotNull:
            broken = R.column(rule.column).isNull()
        elif type(rule) is R.AcceptedValues:
            own = R.REGISTRY[R.AcceptedValues]
            if problem := own.problem(df, rule, context):
                raise ValueError(problem["error"])
            if own.by_join(rule, context):
                known, value = f"_weir_known{i}", R.column(rule.column).cast("string")
                allowed = own.allowed(df, rule, context).select(F.col("_v").alias(known))
                df = df.join(allowed, (value if rule.case_sensitive else F.lower(value)) == F.col(known), "left")
                broken = value.isNotNull() & F.col(known).isNull()
            else:
                broken = R._outside(rule)
        elif type(rule) is R.PositiveNumeric:
            own = R.REGISTRY[R.PositiveNumeric]
            broken = own._low(df, rule) | R._is_nan(df, rule.column)
        else:
            raise ValueError(f"{type(rule).__name__} does not judge single rows")
        marks.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(rule.rule_id)))
    told = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    return df.select(*[R.column(c) for c in columns], told.alias(name))
