"""Store, metrics, quarantine, SQL checks, streams, and the whole pipeline."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from weir import schemas
from weir.functions import sqlchecks
from weir.model import NotNull, RowCountAnomaly
from weir.operators import medallion, metrics
from weir.operators.quarantine import QuarantineStore
from weir.plans.fused import checks
from weir.plans.pipeline import CriticalFailure, PipelineConfig, rule_results, run_pipeline, sql_observability
from weir.sources import paths, synth
from weir.sources.store import TableStore
from weir.streaming import validation

AT = datetime(2024, 6, 1, tzinfo=timezone.utc)


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert store.write(a, "t") == 0
    assert store.write(store.read("t").where("id = 1"), "t") == 1  # overwrites what it reads
    assert store.write(a.withColumn("w", F.lit(1.5)), "t", mode="append", merge_schema=True) == 2
    assert sorted(map(tuple, store.read("t").collect()), key=repr) == sorted([(1, "a", None), (1, "a", 1.5), (2, "b", 1.5)], key=repr)
    assert store.read("t", 0).count() == 2 and store.read("t", 1).count() == 1
    with pytest.raises(ValueError):
        store.write(a.withColumn("q", F.lit(1)), "t", mode="append")
    store.write(a.select(F.col("id").cast("string").alias("id")), "t", mode="append", merge_schema=True)
    assert dict(store.read("t").dtypes)["id"] == "string" and store.read("t").count() == 5
    assert store.upsert(spark.createDataFrame([("1", "new"), ("9", "z")], "id string, v string"), "t", ["id"]) == 4
    assert {r["v"] for r in store.read("t").where("id = '1'").collect()} == {"new"}
    assert store.vacuum("t", keep=1) > 0 and store.versions("t") == [4] and store.read("t").count() == 4
    with pytest.raises(FileNotFoundError):
        store.read("none")


def test_metrics_history_feeds_rules(spark, tmp_path):
    history = metrics.MetricsStore(TableStore(spark, str(tmp_path)))
    assert history.read() is None and history.row_counts("d") == [] and history.statistics("d") == {}
    df = spark.createDataFrame([("a",)] * 5, "c string")
    for i in range(12):
        history.write(checks(df.limit(i % 4 + 1), [NotNull("n", column="c"), RowCountAnomaly("v")], "d"), f"run{i:02d}", "p", AT + timedelta(hours=i))
    assert history.row_counts("d", 3) == [2, 3, 4] and history.row_counts("d", 2, before_run="run11") == [2, 3]
    assert len(history.row_counts("d")) == 10
    rows = history.trend("failure_rate", "d", "n", 4).collect()
    assert [r["run_id"] for r in rows] == ["run08", "run09", "run10", "run11"]
    names = {r["metric_name"] for r in history.read(rule="v").select("metric_name").distinct().collect()}
    assert names == {"failure_rate", "pass_rate", "execution_time_ms", "row_count"}
    assert set(history.read().columns) == {*schemas.schema("metrics").fieldNames(), "run_date"}
    assert metrics.metric_rows(spark, [], "r").count() == 0


def test_quarantine_store(spark, tmp_path):
    jail = QuarantineStore(TableStore(spark, str(tmp_path)), max_records=2)
    df = spark.createDataFrame([(i, "x") for i in range(5)], "id int, _reasons string")
    assert jail.quarantine(None, "silver", "r") == 0 and jail.quarantine(df.limit(0), "silver", "r") == 0
    assert jail.summary("silver") is None
    assert jail.quarantine(df, "silver", "r1", "d", at=AT) == 2
    assert jail.quarantine(df.withColumn("more", F.lit(1)).drop("_reasons"), "silver", "r2", "d", "why", AT) == 2
    found = {(r["_quarantine_reasons"], r["record_count"], r["run_count"]) for r in jail.summary("silver").collect()}
    assert found == {("x", 2, 1), ("why", 2, 1)}
    assert jail.over_limit(11, 100) and not jail.over_limit(10, 100) and not jail.over_limit(0, 0)
    with pytest.raises(ValueError):
        QuarantineStore(jail.store, max_pct=101)


def test_sql_checks(spark):
    odd = "it's `odd`"
    sqlchecks.register_views({"child": spark.createDataFrame([("a",), ("x'y",), (None,)], f"`{odd.replace('`', '``')}` string"), "empty": spark.createDataFrame([], "c string, t timestamp_ntz")})
    out = sqlchecks.run_all_checks(spark, {
        "values": sqlchecks.accepted_values_sql("child", odd, ["A", "X'Y"]), "bad": sqlchecks.accepted_values_sql("child", odd, ["a"]), "unique": sqlchecks.uniqueness_sql("child", [odd]),
        "null": ("not_null", sqlchecks.not_null_sql("child", odd)), "none": ("not_null", sqlchecks.not_null_sql("empty", "c")), "old": ("freshness", sqlchecks.freshness_sql("empty", "t")), "broken": "SELECT nothing FROM nowhere",
    })
    assert {k: v[0] for k, v in out.items()} == {"values": True, "bad": False, "unique": True, "null": False, "none": True, "old": False, "broken": None}


def test_silver_split_and_transforms(spark):
    data = [("1", "c", "p", "x", 2, 1.5, "USD", "2024-01-01 10:00:00"), ("1", "c", "p", "x", 3, 1.5, "USD", "2024-01-02 10:00:00"), ("2", None, "p", "x", 1, 1.0, "EUR", "NOT_A_DATE"), (None, "c", "p", "x", 1, 1.0, "EUR", "2024-01-01 10:00:00"), ("3", "c", "q", "x", None, None, "EUR", "2024-03-01 10:00:00")]
    raw = spark.createDataFrame(data, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.schema("bronze_raw_events").fields))
    orders = medallion.silver_orders(medallion.bronze(raw, "r", AT), AT)
    assert {(r["order_id"], r["quantity"], r["total_amount"]) for r in orders.collect()} == {("1", 3, 4.5), ("3", None, None)}
    assert orders.columns == schemas.schema("silver_orders").fieldNames()
    _, refused = medallion.split_silver(raw)
    assert {r["_reasons"] for r in refused.collect()} == {"customer_id_null,order_timestamp_unreadable", "order_id_null"}
    ltv = medallion.gold_customer_ltv(orders, AT).first()
    assert (ltv["customer_tenure_days"], ltv["orders_per_month"], ltv["ltv_segment"]) == (59, round(2 / (59 / 30), 2), "low")
    for made, table in ((medallion.silver_customers, "silver_customers"), (medallion.silver_products, "silver_products"), (medallion.gold_daily_revenue, "gold_daily_revenue"), (medallion.gold_product_performance, "gold_product_performance"), (medallion.gold_customer_ltv, "gold_customer_ltv")):
        assert set(made(orders, at=AT).columns) == set(schemas.schema(table).fieldNames())
        assert made(orders.limit(0), at=AT).count() == 0


def test_global_rank(spark):
    values = [5.0, 5.0, -1.0, 0.0, 1e300, None, float("nan"), 3.25, float("inf"), float("-inf"), -1e-9]
    df = spark.createDataFrame([(f"k{i:02d}", v) for i, v in enumerate(values)], "k string, v double")
    got = {r["k"]: r["rank"] for r in medallion.global_rank(df, "v", "k", "rank").collect()}
    order = df.orderBy(F.desc_nulls_last("v"), "k").collect()
    assert got == {r["k"]: i + 1 for i, r in enumerate(order)}


@pytest.mark.parametrize("faults", [False, True])
def test_pipeline(spark, tmp_path, faults):
    config = PipelineConfig.for_testing(str(tmp_path), inject_faults=faults, run_at=AT, strict=True)
    report = run_pipeline(spark, config)
    assert {x: y["status"] for x, y in report["layers"].items()} == dict.fromkeys(("bronze", "silver", "gold"), "SUCCESS")
    store = TableStore(spark, str(tmp_path))
    orders = store.read("silver_orders")
    assert orders.count() == orders.select("order_id").distinct().count()
    if faults:
        assert orders.count() < store.read("bronze_raw_events").count()
        assert report["layers"]["silver"]["quarantined"] > 0 and store.read("quarantine_silver").count() == report["layers"]["silver"]["quarantined"]
    else:
        assert orders.count() == 1000 and report["layers"]["silver"]["quarantined"] == 0
    again = run_pipeline(spark, config)
    assert again["layers"]["gold"]["status"] == "SUCCESS" and store.read("silver_orders").count() == orders.count()
    found = sql_observability(spark, store)
    assert {k: v[0] for k, v in found.items()} == {"orders_of_unknown_customers": True, "orders_of_unknown_products": True, "order_id_unique": True, "order_status_known": True, "orders_fresh": False, "customer_id_there": True, "dashboard": None}
    assert found["dashboard"][1].count() > 0
    daily = [r for r in metrics.MetricsStore(store).read(dataset="gold_daily_revenue").where("metric_name = 'row_count_delta_pct'").collect()]
    assert [r["metric_value"] for r in daily] == [0.0]  # the second run saw the first


def test_pipeline_stops_when_told(spark, tmp_path):
    config = PipelineConfig.for_testing(str(tmp_path), fail_on_critical=True, run_at=AT)
    with pytest.raises(CriticalFailure):
        run_pipeline(spark, config, synth.clean_events(spark, 50).drop("currency"))


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    t = datetime(2024, 1, 1)
    data = [(i, t + timedelta(minutes=i), t + timedelta(minutes=i, hours=80 if i % 5 == 0 else 1), "USD", 1.0) for i in range(60)] + [(1, t + timedelta(minutes=1), None, "USD", 1.0)]
    df = spark.createDataFrame(data, "id int, e timestamp, a timestamp, g string, v double")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    seen = []
    validation.validate_stream(stream, [NotNull("n", column="a")], "s", str(tmp_path / "c1"), on_results=lambda _, r: seen.extend(r)).awaitTermination(120)
    assert sum(r.failed_records for r in seen) == 1 and sum(r.total_records for r in seen) == 61
    on_time, late = validation.route_late(df, "e", "a")
    assert (on_time.count(), late.count()) == (48, 13)

    def drain(out, name, mode):
        out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    assert drain(validation.deduplicated(stream, ["id"], "e", "1 hour"), "once", "append").count() == 60
    sums = drain(validation.windowed_sums(stream, "e", "1 hour", "10 minutes", ["g"], "v"), "sums", "complete")
    assert sums.agg(F.sum("record_count")).first()[0] == 61


def test_rule_results_and_paths(spark):
    df = spark.createDataFrame([("1", None), ("2", "x")], "id string, v string")
    results = checks(df, [NotNull("n", column="v"), NotNull("fine", column="id")], "d")
    row = rule_results(results, "r", "id", AT).collect()
    assert [(x["rule_name"], x["record_id"], x["record_snapshot"]) for x in row] == [("n", "1", '{"id":"1"}')]
    assert rule_results(results, "r", "id", AT).columns == schemas.schema("rule_results").fieldNames()
    assert rule_results([], "r", "id", AT) is None
    assert paths.layer_paths("gold", "/x/") == {t: f"/x/{t}" for t in ("gold_daily_revenue", "gold_product_performance", "gold_customer_ltv")}
    with pytest.raises(ValueError):
        paths.layer_paths("platinum")
