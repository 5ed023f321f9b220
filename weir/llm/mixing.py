"""Mixes of sources to target weights, as a curriculum over the mix.

Every source has a weight schedule over training time t in [0, 1]; integrated, it gives the source's
cumulative demand of tokens. A source's documents, in their order and repeated as needed up to the
cap, lie along its own token axis; inverting the cumulative demand turns the middle of each document's
stretch into its training position. Sorting by position (a range sort) mixes the sources.

A source whose copies are used up before its demand is met runs out at that time and gives nothing
after it; this time, ``exhausted_at``, also tells which sources fall short.

Token offsets within a source come from two levels: sums per (source, bucket) first, then sums within
a bucket, so a source that holds a third of all rows is spread over the buckets.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the id's MD5 that name its bucket: 4,096 buckets per source for running sums;
#: a bucket of the largest source is what one task sorts.
BUCKET_DIGITS = 3

#: The columns of a target; one mix may name a source twice.
TARGET = ["mix_id", "source", "share_permille", "max_repeats", "budget_percent"]


def normal_source(source: Column) -> Column:
    return F.lower(F.trim(source))


def utf8_tokens(text: Column) -> Column:
    """One token per UTF-8 byte."""
    return F.octet_length(text).cast("bigint")


def supply(documents: DataFrame, source: str, tokens: Column) -> DataFrame:
    """(source, tokens, docs) with sources in normal form; null sources and texts count too."""
    return documents.select(normal_source(documents[source]).alias("source"), F.coalesce(tokens, F.lit(0)).alias("_t")).groupBy("source").agg(F.sum("_t").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def demand(targets: DataFrame, supplied: DataFrame) -> DataFrame:
    """Per (mix_id, source): target tokens, what the source can give at most, and what it gives.

    ``targets`` has mix_id, source, share_permille, max_repeats, budget_percent. The size of a mix is
    budget_percent of all tokens. ``wanted_x`` and ``ceiling_x`` are exact, in units of 1/100000 token.
    """
    total = supplied.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("decimal(28,0)")).scalar()
    own = supplied.where("source is not null")
    exact = (
        targets.select("mix_id", normal_source(F.col("source")).alias("source"), "share_permille", "max_repeats", "budget_percent")
        .join(own, "source", "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("_all", total)
        .withColumn("wanted_x", (F.col("share_permille").cast("decimal(10,0)") * F.col("budget_percent").cast("decimal(10,0)")).cast("decimal(10,0)") * F.col("_all"))
        .withColumn("ceiling_x", (F.col("max_repeats").cast("decimal(10,0)") * F.col("tokens").cast("decimal(20,0)") * F.lit(100_000)).cast("decimal(38,0)"))
    )
    return exact.select("mix_id", "source", "share_permille", "max_repeats", "budget_percent", "tokens", "wanted_x", "ceiling_x", (F.least(F.col("wanted_x").cast("double"), F.col("ceiling_x").cast("double")) / 100_000).alias("given"))


def exhaustion(plan: DataFrame, drift: Column | None = None, supplied: Column | None = None) -> DataFrame:
    """The plan with ``exhausted_at``: the time at which the integrated demand of the full share has
    used up all copies of the source's documents; null if they last to the end. ``supplied`` are the
    copies' tokens in units of ``ceiling_x``, which it is by default."""
    wanted = F.col("wanted_x").cast("double")
    fraction = (F.col("ceiling_x").cast("double") if supplied is None else supplied) / wanted
    at = invert_linear(F.least(F.lit(1.0), fraction), F.lit(0.0) if drift is None else drift)
    return plan.withColumn("exhausted_at", F.when((wanted > 0) & (fraction < 1 + 1e-9), at))


def shortfalls(plan: DataFrame, drift: Column | None = None, supplied: Column | None = None) -> DataFrame:
    """Sources that stay below their share although every document is taken max_repeats times: their
    copies are used up before the training ends. Within a millionth of the end whole numbers decide."""
    return exhaustion(plan, drift, supplied).where("exhausted_at < 1 - 1e-6 or (exhausted_at is not null and ceiling_x < wanted_x)").select("mix_id", "source")


def token_offsets(documents: DataFrame, doc_id: str, source: str, tokens: Column) -> DataFrame:
    """(source, doc_id, tokens, begin): where each document starts on its source's token axis."""
    rows = documents.select(normal_source(documents[source]).alias("source"), documents[doc_id].alias("_id"), F.coalesce(tokens, F.lit(0)).alias("tokens")).where("source is not null")
    rows = rows.withColumn("_bucket", F.substring(F.md5(F.col("_id").cast("string")), 1, BUCKET_DIGITS))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("source", "_bucket").orderBy("_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return (
        rows.withColumn("_own", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .join(starts, ["source", "_bucket"])
        .select("source", F.col("_id").alias(doc_id), "tokens", (F.col("_before") + F.col("_own")).alias("begin"))
    )


def placed_shortfalls(documents: DataFrame, targets: DataFrame, doc_id: str, source: str, tokens: Column, drift: Column | None = None) -> DataFrame:
    """``shortfalls`` from the sorted curriculum: a source all of whose copies are placed is used up
    where the last of them, in the order of training, ends on its token axis."""
    plan = demand(targets, supply(documents, source, tokens))
    steps = _in_order(_copies(plan.distinct(), documents, targets, doc_id, source, tokens, drift), doc_id).withColumn("_step", F.monotonically_increasing_id())
    placed = steps.groupBy(*TARGET).agg(F.max_by("_end", "_step").alias("_last"), F.sum("tokens").alias("_taken")).withColumnsRenamed({c: f"_{c}" for c in TARGET})
    ends = plan.join(placed, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TARGET]), "left")
    used_up = F.coalesce("_taken", F.lit(0)).cast("decimal(20,0)") * F.lit(100_000) >= F.col("ceiling_x")
    return shortfalls(ends, drift, F.when(used_up, F.coalesce("_last", F.lit(0)).cast("double") * 100_000))


def invert_linear(fraction: Column, drift: Column) -> Column:
    """The time at which ``fraction`` of a source's demand is met under the weight 1 + drift (2t - 1).

    The integral is t + drift (t^2 - t); ``drift`` lies in [-1, 1], 0 keeps the weight even.
    """
    root = F.sqrt((1 - drift) * (1 - drift) + 4 * drift * fraction)
    return F.when(F.abs(drift) < 1e-9, fraction).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (root - (1 - drift)) / (2 * drift))))


def curriculum(documents: DataFrame, targets: DataFrame, doc_id: str, source: str, tokens: Column, drift: Column | None = None) -> DataFrame:
    """(mix_id, source, doc_id, copy_no, tokens, position) of every copy taken, sorted by position.

    A source gives as many whole passes as its demand needs, and of the last pass the documents that
    begin before the demand is met. Positions follow the integrated demand of the full share, so a
    source of too few documents ends at its ``exhausted_at``. ``drift`` is an expression over the columns of the plan (see
    ``invert_linear``). Documents without text have no tokens and are taken with their neighbours.
    """
    plan = demand(targets, supply(documents, source, tokens))
    placed = _copies(plan, documents, targets, doc_id, source, tokens, drift)
    return _in_order(placed.select("mix_id", "source", doc_id, "copy_no", "tokens", "position"), doc_id)


def _in_order(copies: DataFrame, doc_id: str) -> DataFrame:
    return copies.orderBy("mix_id", "position", "source", doc_id, "copy_no")


def _copies(plan: DataFrame, documents: DataFrame, targets: DataFrame, doc_id: str, source: str, tokens: Column, drift: Column | None) -> DataFrame:
    """The copies of ``curriculum`` with the columns of their target and ``_end``, where they end on the
    token axis of all passes."""
    plan = plan.where("tokens > 0 and given > 0").withColumn("drift", F.lit(0.0) if drift is None else drift).select(*TARGET, F.col("tokens").alias("_supply"), "given", (F.col("wanted_x").cast("double") / 100_000).alias("_wanted"), "drift")
    placed = token_offsets(documents, doc_id, source, tokens).join(F.broadcast(plan), "source") if _few(targets) else token_offsets(documents, doc_id, source, tokens).join(plan, "source")
    copies = placed.withColumn("_n", F.least(F.col("max_repeats").cast("bigint"), F.ceil((F.col("given") - F.col("begin")) / F.col("_supply")))).where("_n > 0")
    at = copies.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("copy_no")).withColumn("_begin", F.col("begin") + (F.col("copy_no") - 1) * F.col("_supply"))
    middle = (F.col("_begin") + F.col("tokens") / 2) / F.col("_wanted")
    return at.select(*TARGET, doc_id, "copy_no", "tokens", (F.col("_begin") + F.col("tokens")).alias("_end"), invert_linear(F.least(middle, F.lit(1.0)), F.col("drift")).alias("position"))


#: Target rows up to which the plan (one row each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 10_000


def _few(targets: DataFrame) -> bool:
    return targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def actual_shares(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """Per (mix_id, source): tokens and copies taken, the share reached, and the target share."""
    taken = copies.groupBy("mix_id", "source").agg(F.sum("tokens").alias("taken_tokens"), F.count(F.lit(1)).alias("taken_copies"), F.max("copy_no").alias("repeats"))
    whole = Window.partitionBy("mix_id")
    return plan.join(taken, ["mix_id", "source"], "left").select(
        "mix_id",
        "source",
        "share_permille",
        F.coalesce("taken_tokens", F.lit(0)).alias("taken_tokens"),
        F.coalesce("taken_copies", F.lit(0)).alias("taken_copies"),
        F.coalesce("repeats", F.lit(0)).alias("repeats"),
        F.round(1000 * F.coalesce("taken_tokens", F.lit(0)) / F.sum(F.coalesce("taken_tokens", F.lit(0))).over(whole), 3).alias("reached_permille"),
    )
