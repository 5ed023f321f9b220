"""Rare masks of every column, not only of those with SQL."""

from conftest import rows

from weir.plans import catalog
from weir.plans.core_problems import DISTINCT_CHECKED, LOAD

ORDERS = "order_id string, product_id string, order_status string, quantity int, unit_price double, currency string, customer_id string, source_file string"
METRICS = "pipeline_name string, metric_name string, severity string, layer string, metadata_json string, rule_name string, dataset_name string, run_id string"


def test_malformed_values_of_every_column_come_out(spark, tmp_path):
    orders = [("ORD-1", "PROD-11", "shipped", 5, 1.5, "USD", "CUST-1", "landing/a/load_1.json")] * 39
    orders += [("ord 1", "PROD/11", "shipped!", 555, 1234.5, "US$", "cust-1", "landing/a/load_1.json"), ("x", "x", "x", 1, 1.0, "x", "x", None)]
    metrics = [("daily", "rows", "info", "gold", "{}", "r", "d", "run1")] * 39 + [("daily9", "rows.", "INFO", "gold-", "{", "r ?", "d9", "run1")]
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{tmp_path}/silver_orders.parquet")
    spark.createDataFrame(metrics, METRICS).write.parquet(f"{tmp_path}/metrics.parquet")
    found = {(r["table_name"], r["column_name"]): (r["mask"], r["n"], r["value_count"]) for r in catalog.QUERIES["p2_rare_masks_all"](spark, str(tmp_path)).collect()}
    want = {("silver_orders", c): m for c, m in zip(ORDERS.replace(",", "").split()[::2], ["a 9", "A/99", "a!", "999", "9999.9", "A$", "a-9"], strict=False)}
    want |= {("metrics", c): m for c, m in zip(METRICS.replace(",", "").split()[::2], ["a9", "a.", "A", "a-", "{", "a ?", "a9"], strict=False)}
    assert found == {k: (m, 1, 40) for k, m in want.items()}


def test_the_three_columns_are_as_before(spark, small):
    every = catalog.QUERIES["p2_rare_masks_all"](spark, small)
    assert rows(every.where(every.column_name.isin(DISTINCT_CHECKED))) == rows(catalog.QUERIES["p2_rare_masks"](spark, small))
    assert not every.where(every.column_name.isin(list(LOAD.values()))).count()
