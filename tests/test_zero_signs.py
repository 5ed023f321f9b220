"""Rows left out as duplicates keep the sign of their zeros."""

from conftest import rows
from pyspark.sql import functions as F

from weir.model import Duplicates
from weir.operators.rules import deduplicate, surplus

RULE = Duplicates("once", key_columns=("id",), order_by="t", keep="last")
GIVEN = [
    ("a", 1, -0.0, 5.0, [-0.0, 1.0]), ("a", 2, 3.0, -0.0, [0.0]),
    ("b", 1, 0.0, 1.0, None), ("b", 1, -0.0, 1.0, None), ("b", 1, -0.0, 1.0, None),
    ("c", 1, float("nan"), None, None), ("c", 1, float("nan"), None, None), ("c", 0, float("-inf"), -0.0, [-0.0]),
    (None, 7, -0.0, None, [0.0]), (None, 7, -0.0, None, [-0.0]), (None, None, None, None, None),
]


def test_surplus_is_what_deduplicate_leaves_out(spark):
    df = spark.createDataFrame(GIVEN, "id string, t int, x double, y double, more array<double>").withColumn("small", F.col("x").cast("float"))
    kept, left = deduplicate(df, RULE), surplus(df, RULE)
    assert left.columns == df.columns and left.dtypes == df.dtypes
    assert sorted(rows(kept) + rows(left), key=repr).__repr__() == rows(df).__repr__()
    assert [r["x"].__repr__() for r in left.where("id = 'b'").collect()] == ["-0.0", "-0.0"]
    assert [r.__repr__() for r in rows(left) if r[0] == "a"] == ["('a', 1, -0.0, 5.0, [-0.0, 1.0], -0.0)"]
