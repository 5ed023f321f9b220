"""The ten rules, their dispatch, and the fused plan against single rules."""

import random
from dataclasses import dataclass
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weir.model import AcceptedValues, Contract, DistributionAnomaly, Duplicates, Freshness, NotNull, PositiveNumeric, ReferentialIntegrity, RowCountAnomaly, Rule, SchemaDrift, Severity, UniqueKey
from weir.operators import contracts, quarantine
from weir.operators.rules import Evaluator, deduplicate, register
from weir.plans import fused, rulesets
from weir.plans.fused import check, checks
from weir.sources import synth


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def test_not_null(spark):
    r = check(frame(spark, ["a", None, "b", None]), NotNull("r", column="c"))
    assert (r.passed, r.failed_records, r.failure_rate, r.pass_rate, r.failed_df.count()) == (False, 2, 0.5, 50.0, 2)
    assert check(frame(spark, ["a"]), NotNull("r", column="c")).passed
    empty = check(frame(spark, []), NotNull("r", column="c"))
    assert empty.passed and empty.failure_rate == 0.0
    lost = check(frame(spark, ["a"]), NotNull("r", column="zz"))
    assert not lost.passed and lost.total_records == 0 and "error" in lost.metadata


def test_unique_key(spark):
    r = check(frame(spark, ["1", "2", "2", "3", "3", "3", None, None]), UniqueKey("r", columns=("c",)))
    assert (r.metadata["duplicate_groups"], r.metadata["total_duplicate_records"], r.failed_records, r.failed_df.count()) == (3, 7, 4, 7)
    assert check(frame(spark, ["1", "2"]), UniqueKey("r", columns=["c"])).passed


def test_accepted_values(spark):
    df = frame(spark, ["pending", "YOLO", "TEST", "Delivered", None, "", "YOLO"])
    r = check(df, AcceptedValues("r", column="c", values=("pending", "delivered")))
    assert (r.failed_records, r.metadata["invalid_values_sample"]) == (4, ["", "TEST", "YOLO"])
    assert check(df, AcceptedValues("r", column="c", values=("pending", "delivered"), case_sensitive=True)).failed_records == 5
    given = check(df, AcceptedValues("r", column="c", reference_table="s"), references={"s": frame(spark, ["PENDING", "yolo", None])})
    assert given.failed_records == 3
    assert "error" in check(df, AcceptedValues("r", column="c", reference_table="s")).metadata
    with pytest.raises(ValueError):
        AcceptedValues("r", column="c")


@pytest.mark.parametrize(("kind", "values", "zero", "failed"), [("bigint", [1, -5, 3, -2, None, 0], False, 3), ("bigint", [1, -5, 3, -2, None, 0], True, 2), ("double", [1.0, float("nan"), 0.0, -0.0], False, 3), ("double", [float("nan"), 0.0], True, 1)])
def test_positive(spark, kind, values, zero, failed):
    r = check(frame(spark, values, kind), PositiveNumeric("r", column="c", allow_zero=zero))
    assert r.failed_records == failed == r.failed_df.count()


def test_positive_decimal_text_and_zero_mean(spark):
    r = check(frame(spark, ["0", "5"]).select(F.col("c").cast("decimal(10,2)")), PositiveNumeric("r", column="c"))
    assert r.failed_records == 1 and r.metadata["avg_failing_value"] == 0.0
    assert "error" in check(frame(spark, ["a"]), PositiveNumeric("r", column="c")).metadata


NOW = datetime(2024, 5, 2, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("kind", "values", "hours", "passed"),
    [
        ("timestamp_ntz", [datetime(2024, 5, 1, 12)], 12, True), ("timestamp_ntz", [datetime(2024, 5, 1, 11)], 12, False), ("date", [date(2024, 5, 1)], 24, True), ("date", [date(2024, 4, 30)], 24, False),
        ("string", ["2024-05-01 23:00:00", "NOT_A_DATE"], 2, True), ("string", ["NOT_A_DATE"], 2, False), ("string", [None], 2, False), ("string", [], 2, False), ("timestamp_ntz", [datetime(2025, 1, 1)], 2, True), ("int", [1], 2, False),
    ],
)
def test_freshness(spark, kind, values, hours, passed):
    assert check(frame(spark, values, kind), Freshness("r", column="c", max_age_hours=hours), reference_time=NOW).passed is passed


def test_freshness_does_not_depend_on_the_zone(spark):
    rule, df = Freshness("r", column="c", max_age_hours=12), frame(spark, [datetime(2024, 5, 1, 12)], "timestamp_ntz")
    held = spark.conf.get("spark.sql.session.timeZone")
    try:
        ages = set()
        for zone in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            ages.add(check(df, rule, reference_time=NOW).metadata["age_hours"])
        assert ages == {12.0}
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_duplicates_and_deduplicate(spark):
    data = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "x"), ("b", None, "z"), ("b", 5, "z"), (None, 1, "n"), (None, 1, "n")]
    df = spark.createDataFrame(data, "k string, t int, v string")
    last, first = (Duplicates("r", key_columns=("k",), order_by="t", keep=keep) for keep in ("last", "first"))
    assert sorted(((r.k, r.t, r.v) for r in deduplicate(df, last).collect()), key=repr) == sorted([("a", 2, "x"), ("b", 5, "z"), (None, 1, "n")], key=repr)
    assert sorted(((r.k, r.t, r.v) for r in deduplicate(df, first).collect()), key=repr) == sorted([("a", 1, "x"), ("b", 5, "z"), (None, 1, "n")], key=repr)
    r = check(df, last)
    assert (r.failed_records, r.failed_df.count(), r.metadata["dedup_ratio"]) == (4, 4, round(3 / 7, 4))
    assert check(df.limit(0), last).metadata["dedup_ratio"] == 1.0
    assert check(df, Duplicates("r", key_columns=("k",))).failed_records == 4
    with pytest.raises(ValueError):
        Duplicates("r", key_columns=("k",), keep="any")


def test_schema_drift(spark):
    df = spark.createDataFrame([("1", "a", 1)], "id string, name string, quantity bigint")
    rule = SchemaDrift("r", expected_columns=("id", "name", "quantity"))
    assert check(df, rule).passed
    extra = check(df.withColumn("loyalty_tier", F.lit("x")), rule)
    assert extra.metadata["added_columns"] == ["loyalty_tier"] and extra.failed_records == 1
    assert check(df.withColumn("x", F.lit(1)), SchemaDrift("r", expected_columns=("id",), allow_extra=True)).passed
    assert not check(df.drop("name"), rule).passed
    typed = SchemaDrift("r", expected_schema=StructType().add("id", "string").add("name", "string").add("quantity", "integer"))
    assert list(check(df, typed).metadata["type_changes"]) == ["quantity"]


def test_referential_integrity(spark):
    child, parent = frame(spark, ["a", "b", "x", None, "x"]), spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "p string")
    rule = ReferentialIntegrity("r", child_column="c", parent_table="t", parent_column="p")
    r = check(child, rule, parents={"t": parent})
    assert (r.failed_records, r.metadata["invalid_fk_sample"], r.failed_df.count()) == (2, ["x"], 2)
    assert "error" in check(child, rule).metadata
    assert "error" in check(child, ReferentialIntegrity("r", child_column="c", parent_table="t", parent_column="q"), parents={"t": parent}).metadata


def test_row_count(spark):
    df, rule = frame(spark, ["x"] * 50), RowCountAnomaly("r")
    assert check(df, rule).metadata["baseline_established"]
    drop = check(df, rule, historical_counts=[100, 98, 102, 99, 101])
    assert drop.metadata["anomaly_type"] == "count_drop" and drop.metadata["deviation_pct"] == -50.0
    assert check(df, rule, historical_counts=[20]).metadata["anomaly_type"] == "count_spike"
    assert check(df, rule, historical_counts=[0]).metadata["deviation_pct"] == 100.0
    with pytest.raises(ValueError):
        RowCountAnomaly("r", min_deviation_pct=5)


def test_distribution(spark):
    rule = DistributionAnomaly("r", column="c", approximate=False)
    base = check(frame(spark, [float(i) for i in range(1, 201)] + [float("nan"), None], "double"), rule)
    stats = base.metadata["current_stats"]
    assert base.passed and stats["p50"] == 100.5 and stats["nan_count"] == 1 and stats["count"] == 200
    moved = frame(spark, [float(i) + 500 for i in range(1, 201)], "double")
    r = check(moved, rule, historical_stats={"c": stats})
    assert not r.passed and len(r.metadata["anomalies"]) == 2
    only_bands = check(moved, DistributionAnomaly("r", column="c", z_threshold=1e9), historical_stats={"c": stats})
    assert only_bands.metadata["percentile_anomaly"] and not only_bands.metadata["z_score_anomaly"]
    assert check(moved, rule, historical_stats={"c": {**stats, "stddev": 0.0}}).metadata["z_score"] == float("inf")
    assert "note" in check(frame(spark, [1.0], "double"), rule, historical_stats={"c": stats}).metadata


def test_dispatch(spark):
    df = frame(spark, ["a", None])
    skipped = check(df, NotNull("r", column="c", enabled=False))
    assert skipped.passed and skipped.rule_id == "SKIPPED_NotNull"

    @dataclass(frozen=True)
    class Odd(Rule):
        pass

    assert check(df, Odd("o")).rule_id == "UNKNOWN_Odd"

    class Broken(Evaluator):
        def scan(self, df, rule, context):
            return {"x": F.sum(F.raise_error(F.lit("broken")))}

        def judge(self, rule, total, found, context):
            return True, 0, {}

    register(Odd, Broken())
    one, other = checks(df, [Odd("o"), NotNull("r", column="c")])
    assert one.rule_id == "ERROR_Odd" and one.severity == "critical" and other.failed_records == 1
    assert NotNull("r", severity="CRITICAL", column="c").severity is Severity.CRITICAL
    with pytest.raises(ValueError):
        NotNull("", column="c")


def test_fused_equals_single_and_injected_counts(spark):
    clean = synth.clean_events(spark, 3000)
    dirty = synth.inject(clean)
    rules = rulesets.bronze_rules()
    together = checks(dirty, rules, "bronze_raw_events")
    for rule, r in zip(rules, together, strict=True):
        alone = check(dirty, rule, "bronze_raw_events")
        assert (alone.passed, alone.failed_records, alone.total_records) == (r.passed, r.failed_records, r.total_records)
    by_id = {r.rule_id: r for r in together}
    assert by_id["bronze_customer_id_not_null"].failed_records == dirty.where("customer_id is null").count() > 0
    assert by_id["bronze_order_id_unique"].failed_records == dirty.count() - 3000 > 0
    assert all(r.passed for r in checks(clean, rules))


def test_generator_is_deterministic_and_partition_free(spark):
    a = synth.inject(synth.clean_events(spark, 500, 7)).collect()
    b = synth.inject(synth.clean_events(spark, 500, 7).repartition(3)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) != sorted(map(str, synth.inject(synth.clean_events(spark, 500, 8)).collect()))


def test_contract(spark):
    df = spark.createDataFrame([("1", "a"), ("1", None), ("2", "b")], "id string, name string")
    c = Contract("d", "bronze", df.schema, ("id",), min_not_null={"name": 0.9, "gone": 1.0}, max_duplicate_rate=0.5, min_rows=3, max_rows=3)
    q = contracts.check_quality(df, c)
    assert q["not_null_rates"] == {"name": {"min_required": 0.9, "actual": 0.6667, "passed": False}}
    assert q["duplicate_rate"]["passed"] and q["row_count"]["passed"] and not q["overall_passed"]
    assert not contracts.check_schema(df.withColumn("x", F.lit(1)), c)["passed"]
    assert not contracts.enforce(df, c)["overall_passed"]
    fresh = Contract("d", "silver", df.schema, (), allow_evolution=True, freshness_column="t", max_freshness_hours=2)
    timed = df.withColumn("t", F.lit("2024-05-01 23:00:00"))
    assert contracts.enforce(timed, fresh, NOW)["overall_passed"] and not contracts.enforce(timed, fresh, datetime(2024, 5, 3, tzinfo=timezone.utc))["overall_passed"]


def test_failed_records_unite_layouts_and_reasons(spark):
    a = spark.createDataFrame([(1, None)], "id int, name string")
    b = spark.createDataFrame([("1", 5.0)], "id string, price double")
    results = [check(a, NotNull("n", severity="critical", column="name")), check(b.withColumn("price", -F.col("price")), PositiveNumeric("p", severity="critical", column="price"))]
    found = {tuple(r) for r in quarantine.failed_records(results).select("id", "name", "price", "_reasons").collect()}
    assert found == {("1", None, None, "n"), ("1", None, -5.0, "p")}
    both = spark.createDataFrame([(None, -1.0), (None, -1.0)], "name string, price double")
    results = checks(both, [NotNull("n", severity="critical", column="name"), PositiveNumeric("p", severity="critical", column="price")])
    assert [r["_reasons"] for r in quarantine.failed_records(results).collect()] == ["n,p"]
    assert quarantine.failed_records([]) is None


def test_violations_per_row(spark):
    df = spark.createDataFrame([("a", 1), (None, -1), ("b", None)], "name string, n int")
    marked = fused.violations_per_row(df, [NotNull("n0", column="name"), PositiveNumeric("p0", column="n")])
    assert [r["violated_rules"] for r in marked.collect()] == [[], ["n0", "p0"], []]
