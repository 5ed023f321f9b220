"""Exact percentiles and ranks over all rows, without a sort in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.sources.session import cut

#: Pieces into which a stretch of values is split in one pass.
PIECES = 65_536
_STEP = math.log(1.002)


def _magnitude(v: Column) -> Column:
    """A whole number that grows with the value: steps of 0.2 % of its magnitude, infinities beyond."""
    step = F.signum(v) * (F.ceil(F.log(F.abs(v)) / F.lit(_STEP)) + F.lit(1_000_000))
    return F.when(v == 0, F.lit(0.0)).when(F.abs(v) == F.lit(math.inf), F.signum(v) * F.lit(1e9)).otherwise(step).cast("bigint")


def _piece(v: Column, low: float, high: float) -> Column:
    """Which of PIECES equal pieces of low..high holds ``v``; grows with it."""
    return F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(float(PIECES - 1))).cast("bigint")


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float]) -> list[float | None]:
    """Exact percentiles, interpolated between the two nearest ranks as by ``percentile``.

    Selection by counting: a pass counts values by stretch (of magnitude first), with the least and the
    greatest of each; a stretch in which a wanted rank lies is split further by the next pass, until it
    holds one value. Two or three passes over the rows do for most columns, five for any. Rows are never
    sorted, and a value that most rows share is one count. Null and not-a-number are left out, infinite
    values count; without values all are None.
    """
    v = F.col("_v")
    values = df.select(F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    counts = values.groupBy(F.lit(0).alias("_s"), _magnitude(v).alias("_p"))
    known: dict[int, float] = {}
    ranks: list[int] | None = None
    below = [0]
    while ranks is None or len(known) < len(ranks):
        # one row per stretch, a bounded number
        sizes = counts.agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        if ranks is None:
            sizes = cut(sizes)
            total = sizes.agg(F.sum("n").alias("n")).first()["n"]
            if not total:
                return [None] * len(probabilities)
            places = [p * (total - 1) for p in probabilities]
            ranks = sorted({int(x) + 1 for x in places} | {min(total, int(x) + 2) for x in places})
        upto = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        start = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in below]), F.col("_s") + 1)
        placed = sizes.withColumn("_upto", F.sum("n").over(upto) + start).withColumn("_below", F.col("_upto") - F.col("n"))
        todo = F.array(*[F.lit(r).cast("bigint") for r in ranks if r not in known])
        held = placed.withColumn("_ranks", F.filter(todo, lambda r: (r > F.col("_below")) & (r <= F.col("_upto")))).where(F.size("_ranks") > 0)
        stretches = []
        for row in held.select("low", "high", "_below", "_ranks").collect():  # at most one row per rank
            if row["low"] == row["high"]:
                known |= dict.fromkeys(row["_ranks"], row["low"])
            else:
                stretches.append((row["low"], row["high"], row["_below"]))
        if stretches:
            below = [b for _, _, b in stretches]
            of, piece = F.lit(None).cast("int"), F.lit(None).cast("bigint")
            for i, (low, high, _) in enumerate(stretches):
                within = v.between(F.lit(low), F.lit(high))
                of, piece = F.when(within, F.lit(i)).otherwise(of), F.when(within, _piece(v, low, high)).otherwise(piece)
            counts = values.select("_v", of.alias("_s"), piece.alias("_p")).where("_s is not null").groupBy("_s", "_p")
    out: list[float | None] = []
    for x in places:
        low, high, part = known[int(x) + 1], known[min(total, int(x) + 2)], x - int(x)
        out.append(low if part == 0 or low == high else low + (high - low) * part)
    return out


def global_rank(df: DataFrame, by: str, tie: str, name: str) -> DataFrame:
    """Adds the 1-based rank by ``by`` descending (not-a-number first, nulls last), ties by ``tie``
    ascending (nulls first), without putting all rows into one task.

    Rows are cut into ranges of (by, tie), which stay small even if most rows share one value of ``by``;
    a range starts where the ones before it end. The ranges are kept in the checkpoint folder, for rows
    are counted and ranked by the same ranges.
    """
    order = [F.desc_nulls_last(by), F.asc_nulls_first(tie)]
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*order)
    return placed.withColumn("_rn", F.row_number().over(within)).join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_rn")).cast("int")).drop("_part", "_rn", "_start")
