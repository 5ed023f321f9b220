"""Column profiles by load, from character-class masks.

Cells combine to (load, column, mask) -> count where they are read, so a load or value that holds a
third of all rows is a few rows per task. Null shares, violations of a declared pattern and moves of
masks between loads are read from these counts: under a declared pattern a mask matches it if and only
if its values do (``pattern_mask``), so the pattern is tried once per mask. Only what is defined on
values (distinct counts, shifts too small to show in masks) is counted by value, for the columns that
ask for it. The load before is found on the list of loads; its counts reach the next load through a
union, so comparing two loads is an aggregation and no join of masks or values.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, NumericType, TimestampNTZType, TimestampType

from weir.functions.blank import is_blank
from weir.functions.masks import number_mask, pattern_mask, value_mask
from weir.operators.rules import as_utc
from weir.sources.session import cut


def _text(df: DataFrame, column: str) -> Column:
    """The value as text; null if blank or not-a-number."""
    kind = df.schema[column].dataType.simpleString()
    value = F.col("`" + column.replace("`", "``") + "`")
    if kind in ("double", "float"):
        return F.when(~F.isnan(value), value.cast("string"))
    text = value.cast("string") if not kind.startswith(("array", "map", "struct")) else F.to_json(value)
    return F.when(~is_blank(text), text)


def value_histogram(df: DataFrame, load: Column, columns: list[str]) -> DataFrame:
    """(load_id, column_name, mask, value, n): how often each stored value occurs in each load.

    Rows without a load do not count. ``value`` and ``mask`` are null for rows without value.
    An empty table gives no rows.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _text(df, c).alias("value")) for c in columns])
    return (
        df.select(load.alias("load_id"), F.explode(cells).alias("_cell"))
        .where(~is_blank(F.col("load_id")))
        .select("load_id", "_cell.column_name", "_cell.value")
        .groupBy("load_id", "column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("load_id", "column_name", value_mask(F.col("value")).alias("mask"), "value", "n")
    )


def _number(df: DataFrame, column: str) -> Column:
    """The value as a number: numbers themselves, times as microseconds since 1970, else null."""
    kind = df.schema[column].dataType
    value = F.col("`" + column.replace("`", "``") + "`")
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value), value.cast("double"))
    if isinstance(kind, NumericType):
        return value.cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return as_utc(kind, value).cast("double")
    return F.lit(None).cast("double")


def _numbered_cells(df: DataFrame, load: Column, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _text(df, c).alias("value"), _number(df, c).alias("number")) for c in columns])
    return df.select(load.alias("load_id"), F.explode(cells).alias("_cell")).where(~is_blank(F.col("load_id"))).select("load_id", "_cell.column_name", "_cell.value", "_cell.number")


def mask_histogram(df: DataFrame, load: Column, columns: list[str]) -> DataFrame:
    """(load_id, column_name, mask, n, distinct_estimate, min_number, max_number, min_length,
    max_length) for wide tables and columns of many values: only masks are grouped, values are
    estimated (HyperLogLog++, 5 % standard error). All buffers have a fixed size, so cells are hashed
    and combined where they are read. ``mask`` is null for rows without value; rows without load and
    empty tables give no rows.
    """
    return (
        _numbered_cells(df, load, columns)
        .withColumn("mask", value_mask(F.col("value")))
        .groupBy("load_id", "column_name", "mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.approx_count_distinct("value").alias("distinct_estimate"),
            F.min("number").alias("min_number"),
            F.max("number").alias("max_number"),
            F.min(F.length("value")).alias("min_length"),
            F.max(F.length("value")).alias("max_length"),
        )
    )


def exact_mask_histogram(df: DataFrame, load: Column, columns: list[str]) -> DataFrame:
    """``mask_histogram`` with exact ``distinct_values`` instead of the estimate, and with min_text and
    max_text of values that are no numbers or times, in the order of their bytes.

    Every stored value is grouped once and shuffled with its counts; masks are then rolled up from them.
    """
    return (
        _numbered_cells(df, load, columns)
        .groupBy("load_id", "column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("low"), F.max("number").alias("high"))
        .withColumns({"mask": value_mask(F.col("value")), "text": F.when(F.col("low").isNull(), F.col("value"))})
        .groupBy("load_id", "column_name", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.count("value").alias("distinct_values"),
            F.min("low").alias("min_number"),
            F.max("high").alias("max_number"),
            F.min(F.length("value")).alias("min_length"),
            F.max(F.length("value")).alias("max_length"),
            F.min("text").alias("min_text"),
            F.max("text").alias("max_text"),
        )
    )


def table_profile(masks: DataFrame) -> DataFrame:
    """``mask_histogram`` or ``exact_mask_histogram`` rolled up to (load_id, column_name); the dominant
    mask is the most frequent, ties by the greater mask."""
    valued = F.col("mask").isNotNull()
    exact = "distinct_values" in masks.columns
    distinct = "distinct_values" if exact else "distinct_estimate"
    texts = [F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text")] if exact else []
    return (
        masks.groupBy("load_id", "column_name")
        .agg(
            F.sum("n").alias("row_count"),
            F.sum(F.when(~valued, F.col("n")).otherwise(0)).alias("null_count"),
            F.sum(F.when(valued, F.col(distinct)).otherwise(0)).alias(distinct),
            F.min("min_number").alias("min_number"),
            F.max("max_number").alias("max_number"),
            F.min("min_length").alias("min_length"),
            F.max("max_length").alias("max_length"),
            *texts,
            F.count("mask").alias("mask_count"),
            F.max(F.when(valued, F.struct("n", "mask"))).alias("_top"),
        )
        .select("*", F.col("_top.mask").alias("dominant_mask"), F.col("_top.n").alias("dominant_count"))
        .drop("_top")
    )


def _bound(spec: Any, name: str) -> float | None:
    value = spec[name]
    return None if value is None or value != value else float(value)


def mask_counts(df: DataFrame, load: Column, columns: list[str], specs: Iterable[Any]) -> DataFrame:
    """(load_id, column_name, mask, n, out_of_range), the masks being those of the declared patterns.

    ``specs`` holds a row per declared column: column_name, value_pattern, min_value, max_value. A
    missing bound checks nothing; a value that is no number is not in question for the range. ``mask``
    is null for rows without value; rows without load do not count; an empty table gives no rows.
    """
    declared = {r["column_name"]: r for r in specs}
    cells = []
    for c in columns:
        text, spec = _text(df, c), declared.get(c)
        number = text.try_cast("double")
        off = F.lit(False)
        if spec is not None:
            low, high = _bound(spec, "min_value"), _bound(spec, "max_value")
            off = (number < F.lit(low) if low is not None else off) | (number > F.lit(high) if high is not None else off)
        pattern = spec["value_pattern"] if spec is not None else None
        mask = number_mask(text) if not pattern and isinstance(df.schema[c].dataType, NumericType) else pattern_mask(text, pattern)
        cells.append(F.struct(F.lit(c).alias("column_name"), mask.alias("mask"), F.coalesce(off, F.lit(False)).alias("off")))
    return (
        df.select(load.alias("load_id"), F.explode(F.array(*cells)).alias("_c"))
        .where(~is_blank(F.col("load_id")))
        .groupBy("load_id", "_c.column_name", "_c.mask")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("_c.off").alias("out_of_range"))
    )


def column_profile(masks: DataFrame, specs: Iterable[Any]) -> DataFrame:
    """``mask_counts`` rolled up to (load_id, column_name): rows, rows without value, values, values off
    the pattern and out of range, masks, and the dominant mask (ties by the greater)."""
    valued, off = F.col("mask").isNotNull(), F.lit(False)
    for spec in specs:
        if spec["value_pattern"]:
            whole = F.regexp_like("mask", F.lit(f"\\A(?:{spec['value_pattern']})\\z"))
            off = F.when(F.col("column_name") == spec["column_name"], ~whole).otherwise(off)
    zero = F.lit(0).cast("bigint")
    return masks.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(valued, zero).otherwise(F.col("n"))).alias("null_count"),
        F.sum(F.when(valued, F.col("n")).otherwise(zero)).alias("value_count"),
        F.sum(F.when(valued & off, F.col("n")).otherwise(zero)).alias("off_pattern"),
        F.sum("out_of_range").alias("out_of_range"),
        F.count("mask").alias("mask_count"),
        F.max(F.when(valued, F.struct("n", "mask"))).alias("_top"),
    ).select("*", F.col("_top.mask").alias("dominant_mask"), F.col("_top.n").alias("dominant_count")).drop("_top")


def load_order(loads: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """(load_id, next_load) within each stream. ``loads`` has one row per load."""
    w = Window.partitionBy(stream).orderBy(*order)
    return loads.select("load_id", F.lead("load_id").over(w).alias("next_load"), F.lag("load_id").over(w).alias("load_before"))


def divergence(histogram: DataFrame, totals: DataFrame, order: DataFrame, by: str, only: DataFrame | None = None) -> DataFrame:
    """Half the sum of absolute differences of shares between a load and the one before.

    ``by`` is ``value`` or ``mask``. ``totals`` has (load_id, column_name, value_count). Only loads
    that both hold values are compared, and only the (load_id, column_name) in ``only`` if it is given.
    The result has (load_id, column_name, gap, whole, divergence); the first two are whole numbers, and
    divergence is gap / whole / 2: shares are compared over their common denominator.
    """
    counts = histogram.where(F.col(by).isNotNull()).groupBy("load_id", "column_name", by).agg(F.sum("n").alias("n"))
    linked = order.select("load_id", "next_load")
    own = counts.select("load_id", "column_name", by, "n", F.lit(0).cast("bigint").alias("before"))
    passed_on = counts.join(linked.where("next_load is not null"), "load_id").select(F.col("next_load").alias("load_id"), "column_name", by, F.lit(0).cast("bigint").alias("n"), F.col("n").alias("before"))
    held = totals.where("value_count > 0").select("load_id", "column_name", F.col("value_count").cast("decimal(19,0)").alias("_now"))
    both = held.join(held.join(linked, "load_id").select(F.col("next_load").alias("load_id"), "column_name", F.col("_now").alias("_before")), ["load_id", "column_name"])
    if only is not None:
        both = both.join(only.select("load_id", "column_name"), ["load_id", "column_name"], "left_semi")
    gap = F.abs(F.col("n").cast("decimal(18,0)") * F.col("_before") - F.col("before").cast("decimal(18,0)") * F.col("_now"))
    return (
        own.unionByName(passed_on)
        .groupBy("load_id", "column_name", by)
        .agg(F.sum("n").alias("n"), F.sum("before").alias("before"))
        .join(both, ["load_id", "column_name"])
        .groupBy("load_id", "column_name")
        .agg(F.sum(gap).cast("decimal(38,0)").alias("gap"), F.first((F.col("_now") * F.col("_before")).cast("decimal(38,0)")).alias("whole"))
        .withColumn("divergence", F.col("gap").cast("double") / F.col("whole").cast("double") / 2)
    )


def rare_masks(masks: DataFrame, least_share: float = 0.05) -> DataFrame:
    """Masks that fewer than ``least_share`` of the values of their load and column have."""
    w = Window.partitionBy("load_id", "column_name")
    return masks.where("mask is not null").withColumn("value_count", F.sum("n").over(w)).where(F.col("n") / F.col("value_count") < F.lit(least_share))


def over_share(part: str, whole: str, share: float) -> Column:
    """Whether ``part`` is more than ``share`` of ``whole``, in whole numbers; false without a whole."""
    exact = Decimal(str(share))
    return F.col(part).cast("decimal(20,0)") > F.col(whole).cast("decimal(20,0)") * F.lit(exact)


def shifted(masks: DataFrame, values: DataFrame, totals: DataFrame, order: DataFrame, shift: float) -> DataFrame:
    """(load_id, column_name) of every load whose values moved by more than ``shift`` against the load
    before. What masks moved, values moved at least as far, so the divergence of masks settles most
    loads that did; the values of the others are compared themselves."""
    enough = F.col("gap") > F.col("whole") * F.lit(Decimal(str(2 * shift)))
    by_mask = cut(divergence(masks, totals, order, "mask").select("load_id", "column_name", enough.alias("_moved")))
    by_value = divergence(values, totals, order, "value", only=by_mask.where("not _moved")).where(enough)
    return by_mask.where("_moved").select("load_id", "column_name").unionByName(by_value.select("load_id", "column_name"))


def load_issues(masks: DataFrame, values: DataFrame, specs: Iterable[Any], order: DataFrame, distinct_columns: list[str], shift_columns: list[str], null_share: float = 0.2, pattern_share: float = 0.05, range_share: float = 0.05, shift: float = 0.5) -> DataFrame:
    """(column_name, load_id, issue) of every load that breaks a bound; see TESTDATA.md, p2.

    ``masks`` comes from ``mask_counts``, is read several times and should be cut; ``values`` comes from
    ``value_histogram`` over the distinct and shift columns.
    """
    profile = cut(column_profile(masks, list(specs)))  # a row per load and column
    broken = F.array(
        F.when(over_share("null_count", "row_count", null_share), F.lit("nulls")),
        F.when(over_share("off_pattern", "value_count", pattern_share), F.lit("pattern")),
        F.when(over_share("out_of_range", "value_count", range_share), F.lit("range")),
    )
    found = profile.select("column_name", "load_id", F.explode(F.array_compact(broken)).alias("issue"))
    if distinct_columns:
        counts = cut(values.where(F.col("column_name").isin(distinct_columns) & F.col("value").isNotNull()).groupBy("load_id", "column_name").agg(F.count(F.lit(1)).alias("now")))
        before = counts.join(order.where("next_load is not null"), "load_id").select(F.col("next_load").alias("load_id"), "column_name", F.col("now").alias("before"))
        changed = counts.join(before, ["load_id", "column_name"]).where("now * 2 < before or now > before * 2")
        found = found.unionByName(changed.select("column_name", "load_id", F.lit("distinct").alias("issue")))
    if shift_columns:
        of = F.col("column_name").isin(shift_columns)
        moved = shifted(masks.where(of), values.where(of), profile, order, shift)
        found = found.unionByName(moved.select("column_name", "load_id", F.lit("shift").alias("issue")))
    return found
