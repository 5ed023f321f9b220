"""Percentiles from counts in signed logarithmic buckets.

A bucket of index i holds magnitudes in (g^(i-1), g^i] with g = (1+a)/(1-a); its stand-in
2 g^i / (g+1) is off by at most the share a of any value in it (below 1e-307 doubles are too sparse
for that), and the bucket's edges are bounds of the value itself. Negative values mirror positive ones,
zero has its own bucket, and so has either infinity. A sketch is a table of (groups, sign, bucket, n):
sketches of days, files or partitions merge by adding n. Counting combines before the shuffle, and a
group has at most as many buckets as the doubles between the smallest and largest magnitude need (about
71,000 a sign at 1 %), so no group, however large, is ever gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bucket of infinite values, beyond that of any double.
INFINITE = 1 << 30
_LARGEST = 1.7976931348623157e308


def gamma(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must lie between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def bucket_index(value: Column, accuracy: float) -> Column:
    finite = F.ceil(F.log(F.abs(value)) / F.lit(math.log(gamma(accuracy))))
    return F.when(value == 0, F.lit(0)).when(F.abs(value) == F.lit(math.inf), F.lit(INFINITE)).otherwise(finite).cast("int")


def sketch(df: DataFrame, value: str, groups: list[str], accuracy: float = 0.01) -> DataFrame:
    """(groups..., sign, bucket, n). Null and not-a-number are not counted."""
    v = F.col(value).cast("double")
    return (
        df.select(*groups, v.alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .select(*groups, F.signum("_v").cast("int").alias("sign"), bucket_index(F.col("_v"), accuracy).alias("bucket"))
        .groupBy(*groups, "sign", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of one accuracy added up over everything but ``groups``."""
    return sketches.groupBy(*groups, "sign", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], probabilities: list[float], accuracy: float = 0.01) -> DataFrame:
    """(groups..., probability, estimate, lower_bound, upper_bound, value_count) of a merged sketch.

    The estimate stands for the value of rank ceil(p * count), at least 1, in ascending order; it is
    off by at most ``accuracy`` of that value, which lies between the bounds (the bucket's edges, a
    trillionth wider for the rounding of powers). Infinite values stand for themselves. A group without
    values has no row.
    """
    g = gamma(accuracy)
    order = F.col("sign") * F.when(F.col("sign") == 0, F.lit(0)).otherwise(F.col("bucket"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    below = w.orderBy("sign", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketches.select(*groups, "sign", "bucket", "n", F.sum("n").over(below).alias("_upto"), F.sum("n").over(w).alias("value_count"))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("probability"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("value_count"))).alias("rank")) for p in probabilities])
    # from the lower edge of the bucket, which is a double whenever a value of the bucket is
    edge = F.pow(F.lit(g), F.col("bucket") - 1)
    near, far = edge * F.lit(1 - 1e-12), edge * F.lit(g * (1 + 1e-12))

    def signed(magnitude: Column) -> Column:
        value = F.when(F.col("bucket") == INFINITE, F.lit(math.inf)).otherwise(F.least(magnitude, F.lit(_LARGEST)))
        return F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * value)

    return (
        ranked.select("*", F.explode(wanted).alias("_w"))
        .where((F.col("_w.rank") <= F.col("_upto")) & (F.col("_w.rank") > F.col("_upto") - F.col("n")))
        .select(
            *groups,
            F.col("_w.probability").alias("probability"),
            signed(edge * F.lit(2 * g / (g + 1))).alias("estimate"),
            F.least(signed(near), signed(far)).alias("lower_bound"),
            F.greatest(signed(near), signed(far)).alias("upper_bound"),
            "value_count",
        )
    )


def exact_between(df: DataFrame, value: str, groups: list[str], found: DataFrame) -> DataFrame:
    """(groups..., probability, exact): the value itself of each percentile in ``found`` (from
    ``quantiles``), looked for between its bounds only; without a row where it does not lie there.

    Distinct values are counted first and only those between the bounds of a percentile are ranked.
    """
    v = F.col(value).cast("double")
    counted = df.select(*groups, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n"))
    bounds = found.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], "probability", "lower_bound", "upper_bound", F.greatest(F.lit(1), F.ceil(F.col("probability") * F.col("value_count"))).alias("_rank"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(groups)]
    met = counted.join(bounds, [*same, F.col("_v") <= F.col("upper_bound")])
    below = met.groupBy(*groups, "probability", "_rank").agg(F.sum(F.when(F.col("_v") < F.col("lower_bound"), F.col("_n")).otherwise(0)).alias("_below"))
    upto = Window.partitionBy(*groups, "probability").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = met.where("_v >= lower_bound").select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(groups)], F.col("probability").alias("_p"), "_v", "_n", F.sum("_n").over(upto).alias("_upto"))
    on = [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(groups)]
    last = F.col("_below") + F.col("_upto")
    return below.join(inside, [*on, F.col("probability") == F.col("_p")]).where((F.col("_rank") <= last) & (F.col("_rank") > last - F.col("_n"))).select(*groups, "probability", F.col("_v").alias("exact"))
