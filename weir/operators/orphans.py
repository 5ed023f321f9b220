"""References to keys that do not exist at the time of the reference.

References and changes of existence are signed counts per key and day (``key_deltas``). Both combine
before they are shuffled, so a key that a third of all rows name is one row per task and day. Added up
they are the ledger: a key with references and without existence is an orphan. ``carry`` folds new
deltas into the balances of an earlier day, so the report of a day needs no earlier rows.

For single references the running balance over a key's days tells for each (key, day) whether the key
was missing, not yet there, deleted, there, or changed within the day. Days on which a key was simply
there drop out; only references of the others are joined back, on (table, key, day), where adaptive
execution splits a skewed partition. A day on which a key changed carries its few changes along as a
list, in which each reference finds the state at its own time; references are never sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.sources.session import cut

_KEY = ["ref_table", "ref_key"]


def existence_changes(history: DataFrame, table: str, key: str, kind: str, at: str, opening: DataFrame | None = None) -> DataFrame:
    """(ref_table, ref_key, at, alive, delta): repeated rows once; alive is 1 after created or restored
    and 0 after deleted, delta what that adds to the state before, in order of time.

    Rows with a null in any of the four are left out. Of changes at one time the greater state is last.
    ``opening`` are the balances before the first of these changes; without it no key existed.
    """
    told = history.select(F.col(table).alias("ref_table"), F.col(key).alias("ref_key"), F.col(at).alias("at"), F.when(F.col(kind) == "deleted", 0).when(F.col(kind).isNotNull(), 1).alias("alive")).dropna().distinct()
    if opening is not None:
        told = told.unionByName(opening.select(*_KEY, F.lit(None).cast(told.schema["at"].dataType).alias("at"), F.col("existence").cast("int").alias("alive")))
    of_key = Window.partitionBy(*_KEY).orderBy(F.asc_nulls_first("at"), "alive")  # the changes of one key
    return told.withColumn("delta", F.col("alive") - F.lag("alive", 1, 0).over(of_key)).where("at is not null")


def key_deltas(references: DataFrame, changes: DataFrame) -> DataFrame:
    """(ref_table, ref_key, day, refs, existence, changes): signed counts of each key and day.

    ``references`` has (ref_table, ref_key, at) and, if references are withdrawn, ``delta`` with -1 for
    those; ``changes`` comes from ``existence_changes``.
    """
    day = F.to_date("at").alias("day")
    zero = F.lit(0).cast("bigint")
    one = F.col("delta").cast("bigint") if "delta" in references.columns else F.lit(1).cast("bigint")
    counted = references.select(*_KEY, day, one.alias("_n")).groupBy(*_KEY, "day").agg(F.sum("_n").alias("refs"), F.lit(0).cast("bigint").alias("existence"), F.lit(0).cast("bigint").alias("changes"))
    changed = changes.select(*_KEY, day, "delta").groupBy(*_KEY, "day").agg(F.lit(0).cast("bigint").alias("refs"), F.sum("delta").cast("bigint").alias("existence"), F.count(F.lit(1)).alias("changes"))
    return counted.unionByName(changed).groupBy(*_KEY, "day").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("refs", "existence", "changes")])


def carry(balances: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """(ref_table, ref_key, refs, existence, changes): the balances with the deltas of later days."""
    columns = [*_KEY, "refs", "existence", "changes"]
    both = deltas.select(*columns) if balances is None else balances.select(*columns).unionByName(deltas.select(*columns))
    return both.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in columns[2:]])


def orphan_keys(balances: DataFrame) -> DataFrame:
    """(ref_table, ref_key, refs, key_state): keys with references and without existence; missing keys
    never existed, deleted ones did."""
    return balances.where("refs > 0 and existence = 0").select(*_KEY, "refs", F.when(F.col("changes") == 0, "missing").otherwise("deleted").alias("key_state"))


def ledger(references: DataFrame, changes: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Per (ref_table, ref_key, day): the deltas, the balances before the day, and the state.

    state is missing, late, deleted, present, or mixed where the key changed that day. A key is late
    until its first change if one is known, missing if none is. ``opening`` are the balances of the
    days before.
    """
    days = key_deltas(references, changes)
    if opening is not None:
        days = days.unionByName(opening.select(*_KEY, F.lit(None).cast("date").alias("day"), "refs", "existence", "changes"))
    of_key = Window.partitionBy(*_KEY)
    earlier = of_key.orderBy(F.asc_nulls_first("day")).rowsBetween(Window.unboundedPreceding, -1)
    known = days.select(
        "*",
        F.coalesce(F.sum("existence").over(earlier), F.lit(0)).alias("existing"),
        F.coalesce(F.sum("changes").over(earlier), F.lit(0)).alias("changed"),
        F.sum("changes").over(of_key).alias("_ever"),
    ).where("day is not null")
    state = (
        F.when(F.col("_ever") == 0, "missing")
        .when(F.col("changes") > 0, "mixed")
        .when(F.col("changed") == 0, "late")
        .when(F.col("existing") == 0, "deleted")
        .otherwise("present")
    )
    return known.select(*_KEY, "day", "refs", F.col("existence").alias("existence_delta"), "existing", "changed", state.alias("state"))


def orphan_references(references: DataFrame, changes: DataFrame, payload: list[str], opening: DataFrame | None = None) -> DataFrame:
    """(payload..., ref_table, ref_key, at, key_state) of every reference without existing key.

    ``references`` has ref_table, ref_key, at and the payload columns; rows with a null key, table or
    time are left out. key_state: missing, late (created after ``at``), deleted. Repeated references
    stay repeated. Other columns of ``references`` play no part, whatever their names.
    """
    named, payload = payload, [f"_p{i}" for i in range(len(payload))]
    references = references.select(*[F.col(c).alias(p) for c, p in zip(named, payload, strict=True)], *_KEY, "at").where("ref_table is not null and ref_key is not null and at is not null")
    doubtful = ledger(references.select(*_KEY, "at"), changes, opening).where("state <> 'present' and refs > 0").select(*_KEY, "day", "state", "existing", "changed")
    # the changes of one key on one day
    within = changes.groupBy(*_KEY, F.to_date("at").alias("day")).agg(F.sort_array(F.collect_list(F.struct("at", "delta"))).alias("_changes"))
    # written once: a row per key and day of reference, without those of present keys
    doubtful = cut(doubtful.join(within, [*_KEY, "day"], "left"))
    met = references.withColumn("day", F.to_date("at")).join(doubtful, [*_KEY, "day"])
    before = F.filter("_changes", lambda c: c["at"] <= F.col("at"))
    settled = met.withColumn("_before", before)
    existing = F.col("existing") + F.aggregate("_before", F.lit(0).cast("bigint"), lambda total, c: total + c["delta"])
    unborn = (F.col("changed") == 0) & (F.size("_before") == 0)
    key_state = F.when(F.col("state") != "mixed", F.col("state")).when(unborn, "late").when(existing == 0, "deleted")
    return settled.select(*[F.col(p).alias(c) for c, p in zip(named, payload, strict=True)], *_KEY, "at", key_state.alias("key_state")).where("key_state is not null")
