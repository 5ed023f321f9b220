"""Profiles with exact distinct counts and the range of texts."""

import duckdb
from pyspark.sql import functions as F

from weir.operators import profile
from weir.plans import catalog


def test_distinct_counts_are_exact(spark):
    data = [("l", f"v{i % 997}", i % 1501, float("nan") if i < 3 else -0.5 * (i % 7)) for i in range(3000)] + [("l", None, None, None), ("l", " ", 1, 1.0), (None, "zz", 9, 9.0)]
    df = spark.createDataFrame(data, "load string, s string, i int, d double")
    found = {r["column_name"]: r for r in profile.table_profile(profile.exact_mask_histogram(df, F.col("load"), ["s", "i", "d"])).collect()}
    assert {c: r["distinct_values"] for c, r in found.items()} == {"s": 997, "i": 1501, "d": 8}
    assert (found["s"]["min_text"], found["s"]["max_text"], found["s"]["null_count"], found["s"]["row_count"], found["s"]["mask_count"]) == ("v0", "v996", 2, 3002, 3)
    assert (found["i"]["min_text"], found["i"]["min_number"], found["i"]["max_number"]) == (None, 0.0, 1500.0)
    assert (found["d"]["null_count"], found["d"]["min_number"], found["d"]["max_number"]) == (4, -3.0, 1.0)
    assert profile.exact_mask_histogram(df.limit(0), F.col("load"), ["s"]).count() == 0


def test_profile_of_the_small_table(spark, small):
    found = {tuple(r) for r in catalog.QUERIES["p2_profile"](spark, small).where("column_name in ('order_id', 'product_id', 'currency') and distinct_values > 0").select("load_id", "column_name", "distinct_values", "min_text", "max_text").collect()}
    parts = [f"SELECT source_file, '{c}', count(DISTINCT {c}), min({c}), max({c}) FROM '{small}/silver_orders.parquet' WHERE trim(source_file) <> '' AND trim({c}) <> '' GROUP BY 1" for c in ("order_id", "product_id", "currency")]
    assert found == set(duckdb.sql(" UNION ALL ".join(parts)).fetchall())
