"""Errors of rules, reference lists, surplus rows of hot keys, sums beyond fixed point, failing writes."""

import random
from dataclasses import dataclass
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weir.model import AcceptedValues, CheckResult, DistributionAnomaly, Duplicates, NotNull, Rule
from weir.operators import medallion, metrics, quarantine
from weir.operators.rules import REGISTRY, Context, Evaluator, deduplicate, register, surplus
from weir.plans import fused
from weir.sources import paths, session
from weir.sources.store import TableStore


@dataclass(frozen=True)
class Odd(Rule):
    pass


class OddEvaluator(Evaluator):
    def judge(self, rule, total, found, context):
        raise KeyError("lost")


def test_any_exception_is_one_result(spark):
    register(Odd, OddEvaluator())
    try:
        results = fused.checks(spark.createDataFrame([(1,), (None,)], "a int"), [NotNull("n", column="a"), Odd("o")], "t")
    finally:
        del REGISTRY[Odd]
    assert [r.failed_records for r in results] == [1, 0]
    assert results[1].rule_id == "ERROR_Odd" and results[1].severity == "critical" and "lost" in results[1].metadata["error"]


def test_history_without_a_mean_is_no_history(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("v"))
    r = fused.check(df, DistributionAnomaly("d", column="v"), historical_stats={"v": {"p50": 1.0}})
    assert r.passed and r.metadata["baseline_established"]


@pytest.mark.parametrize("case", [True, False])
def test_reference_lists_count_and_are_missed(spark, case):
    df = spark.createDataFrame([("a",), ("b",), ("B",), ("c",), (None,)], "v string")
    rule = AcceptedValues("r", column="v", values=("a",), reference_table="known", case_sensitive=case)
    assert fused.check(df, rule).metadata["error"] == "reference table not given: known"
    context = Context(references={"known": spark.createDataFrame([("b",), ("b",), (None,)], "x string")})
    failing = ["B", "c"] if case else ["c"]
    assert fused.check(df, rule, context=context).failed_records == len(failing)
    marked = fused.violations_per_row(df.withColumn("_v", F.lit(1)), [rule, NotNull("n", column="v")], context=context)
    assert sorted(r["v"] for r in marked.collect() if r["violated_rules"] == ["r"]) == failing
    assert marked.columns == ["v", "_v", "violated_rules"] and marked.count() == 5
    with pytest.raises(ValueError, match="known"):
        fused.violations_per_row(df, [rule])


@pytest.mark.parametrize("keep", ["first", "last"])
def test_surplus_rows_are_those_not_kept(spark, keep):
    r = random.Random(7)
    data = [(None if i % 3 == 0 else f"k{r.randint(0, 40)}", r.choice([None, 1, 2, 3]), r.choice(["x", "y", None])) for i in range(900)]
    df = spark.createDataFrame(data, "k string, t int, v string")
    for order in ("t", None):
        rule = Duplicates("d", key_columns=("k",), order_by=order, keep=keep)
        left = surplus(df, rule)
        assert rows(left.unionByName(deduplicate(df, rule))) == rows(df) and left.count() == fused.check(df, rule).failed_records
        assert "Window" not in left._jdf.queryExecution().executedPlan().toString()


def test_money_loses_nothing(spark):
    orders = spark.createDataFrame([("p", 1, 0.004, 1e30), ("p", 1, 0.004, 2.5), ("q", 1, float("nan"), 1.0), ("q", 2, 3.0, float("nan"))], "product_id string, quantity int, unit_price double, total_amount double")
    orders = orders.selectExpr("*", "'c' AS customer_id", "'USD' AS currency", "DATE'2024-01-01' AS order_date")
    found = {r["product_id"]: r for r in medallion.silver_products(orders).collect()}
    assert abs(found["p"]["avg_unit_price"] - 0.004) < 1e-12 and found["p"]["total_revenue"] == 1e30
    assert found["q"]["avg_unit_price"] == 3.0 and found["q"]["total_revenue"] == 1.0
    assert medallion.silver_customers(orders).first()["total_spend"] == 1e30


def test_failing_writes_end_no_run(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    (tmp_path / "metrics").write_text("in the way")
    (tmp_path / "quarantine_gold").write_text("in the way")
    kept, jail = metrics.MetricsStore(store), quarantine.QuarantineStore(store, max_records=3)
    assert kept.write([CheckResult("r", True)], "run") == 0 and len(kept.errors) == 1
    df = spark.range(10).withColumn("_reasons", F.lit("x"))
    assert jail.quarantine(df, "gold", "run") == 0 and len(jail.errors) == 1
    assert jail.quarantine(df, "silver", "run") == 3 and jail.left_out == 14  # 7 of each


def test_metrics_retention(spark, tmp_path):
    from datetime import datetime, timezone

    kept = metrics.MetricsStore(TableStore(spark, str(tmp_path)))
    for day in (1, 9):
        kept.write([CheckResult("r", True, 5)], f"run{day}", at=datetime(2024, 1, day, tzinfo=timezone.utc))
    assert kept.drop_before("2024-01-05") == 3 and {r["run_id"] for r in kept.read().collect()} == {"run9"}


def test_a_cluster_must_name_its_folders(spark, monkeypatch):
    monkeypatch.delenv(paths.BASE_VARIABLE, raising=False)
    monkeypatch.setattr(paths, "is_local", lambda s: False)
    with pytest.raises(ValueError, match="name the base folder"):
        TableStore(spark)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default)))
