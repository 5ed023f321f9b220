"""Exact percentiles and ranks, also where one value or a narrow band holds most rows."""

import math
import random

from pyspark.sql import functions as F

from weir.operators.ordering import exact_quantiles, global_rank

WANTED = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]


def test_exact_quantiles(spark):
    r = random.Random(4)
    bands = [1000 + r.random() / 1e9 for _ in range(400)] + [float(i) for i in range(200)]
    for values in ([1.0], [2.0, 1.0], [5.0] * 50 + [float(r.randint(-40, 40)) for _ in range(301)], [-0.0, 0.0, -3.5], [-1.7e308, 1.7e308, 5e-324, 0.0], bands, []):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        exact = df.where(~F.isnan("v")).agg(F.percentile("v", F.array(*[F.lit(p) for p in WANTED])).alias("q")).first()["q"] or [None] * 6
        found = exact_quantiles(df, "v", WANTED)
        assert all((a is None and b is None) or a == b or abs(a - b) <= 1e-12 * abs(a) for a, b in zip(exact, found, strict=True)), (exact, found)


def test_infinite_values_count(spark):
    df = spark.createDataFrame([(v,) for v in (-math.inf, 1.0, 2.0, math.inf, math.inf)], "v double")
    assert exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0]) == [-math.inf, 1.0, 2.0, math.inf, math.inf]


def test_rank_of_rows_that_share_a_value(spark):
    r = random.Random(6)
    data = [(f"k{i:04d}", 0.0 if i % 2 else r.choice([1.5, -2.0, None, math.nan, math.inf, float(i)])) for i in range(2000)] + [(None, 0.0)]
    df = spark.createDataFrame(data, "k string, v double").withColumn("n", F.lit(1))
    found = {x["k"]: x["rank"] for x in global_rank(df, "v", "k", "rank").collect()}
    by = lambda x: (x[1] is None, 0 if x[1] is None else -1e400 if math.isnan(x[1]) else -x[1], x[1] is not None and not math.isnan(x[1]), x[0] is not None, x[0] or "")
    assert [k for k, _ in sorted(data, key=by)] == sorted(found, key=found.get)
    parts = df.repartitionByRange(8, F.desc_nulls_last("v"), F.asc_nulls_first("k")).groupBy(F.spark_partition_id()).count().collect()
    assert max(x["count"] for x in parts) < 600  # half the rows share one value
    assert global_rank(df.limit(0), "v", "k", "rank").count() == 0
