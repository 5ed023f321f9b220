"""Percentiles within their bound, merging, infinite values, one group with most rows."""

import math
import random

from conftest import rows
from pyspark.sql import functions as F

from weir.llm import quantile_sketch

WANTED = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def value_at(ordered, p):
    return ordered[max(1, -int(-p * len(ordered) // 1)) - 1]


def test_quantiles_within_bound_and_merge(spark):
    r = random.Random(7)
    values = [r.choice([-1, 1]) * 10 ** r.uniform(-8, 8) for _ in range(4000)] + [0.0] * 40 + [5e-324, 1.7e308]
    data = [(i % 5, v) for i, v in enumerate(values)] + [(0, float("nan")), (0, None)]
    df = spark.createDataFrame(data, "day int, v double").withColumn("bucket", F.lit("clash"))
    parts = quantile_sketch.sketch(df, "v", ["day"], 0.01)
    whole = quantile_sketch.merge(parts, [])
    assert rows(whole.select("sign", "bucket", "n")) == rows(quantile_sketch.sketch(df, "v", [], 0.01).select("sign", "bucket", "n"))
    ordered = sorted(values)
    for row in quantile_sketch.quantiles(whole, [], WANTED, 0.01).collect():
        exact = value_at(ordered, row["probability"])
        assert row["value_count"] == len(values)
        assert abs(row["estimate"] - exact) <= 0.01 * abs(exact) * (1 + 1e-9) or abs(exact) < 1e-300
        assert row["lower_bound"] <= exact <= row["upper_bound"] or abs(exact) < 1e-300
    assert quantile_sketch.quantiles(quantile_sketch.sketch(df.limit(0), "v", ["day"]), ["day"], [0.5]).count() == 0


def test_infinite_values_are_counted(spark):
    df = spark.createDataFrame([(v,) for v in (math.inf, -math.inf, 1.0, 2.0, math.inf)], "v double")
    found = quantile_sketch.quantiles(quantile_sketch.sketch(df, "v", []), [], [0.0, 0.4, 1.0]).orderBy("probability").collect()
    assert [r["estimate"] for r in found][::2] == [-math.inf, math.inf] and abs(found[1]["estimate"] - 1) <= 0.01
    assert all(r["value_count"] == 5 for r in found) and found[2]["lower_bound"] == math.inf


def test_exact_values_lie_between_the_bounds(spark):
    r = random.Random(3)
    data = [("hot" if i % 3 else r.choice(["a", None]), round(r.gauss(0, 50), 2)) for i in range(6000)]
    df = spark.createDataFrame(data, "g string, v double").withColumn("probability", F.lit(1))
    found = quantile_sketch.quantiles(quantile_sketch.sketch(df, "v", ["g"]), ["g"], WANTED)
    exact = {(x["g"], x["probability"]): x["exact"] for x in quantile_sketch.exact_between(df, "v", ["g"], found).collect()}
    for g in ("hot", "a", None):
        ordered = sorted(v for h, v in data if h == g)
        assert all(exact[g, p] == value_at(ordered, p) for p in WANTED)
    wrong = found.withColumns({"lower_bound": F.lit(900.0), "upper_bound": F.lit(901.0)})
    assert quantile_sketch.exact_between(df, "v", ["g"], wrong).count() == 0
