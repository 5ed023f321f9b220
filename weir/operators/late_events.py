"""Aggregates by event time that late records correct, with a cut-off for lateness.

Plan: one shuffle on the record key. The first delivery of every key is a ``min`` of structs, which
combines before the shuffle, so a key that holds a third of all rows is one row per map task. Each
partition is then a shard: sorted by arrival it streams through one finger B-tree per group. Records of
one arrival slot, group and event slot become one partial (numpy); the tree takes it, takes it late,
into a period that was closed, or refuses it below the cut-off, and this is the records' outcome. A
shard holds only the partials of the lateness horizon, not rows. Shards send changes of (group, period,
publication); these are added up across shards, so a hot group or day is spread over all shards.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.operators.finger_tree import REFUSED, FingerBTree
from weir.sources.session import ensure_importable

DAY_US = 86_400_000_000
_OUT = "kind string, record_key string, grp string, period bigint, tick bigint, amount decimal(38,0), n bigint, outcome string"
_ARROW = pa.schema(
    [("kind", pa.string()), ("record_key", pa.string()), ("grp", pa.string()), ("period", pa.int64()), ("tick", pa.int64()), ("amount", pa.decimal128(38, 0)), ("n", pa.int64()), ("outcome", pa.string())]
)


def first_deliveries(df: DataFrame, key: str, event: str, arrival: str, keep: list[str]) -> DataFrame:
    """Of each key the row with the smallest arrival, then event time, then the other columns.

    Rows with a null event or arrival time cannot be placed and are left out; null keys are one key.
    """
    order = [arrival, event, *keep]
    return (
        df.select(F.col(key).cast("string").alias("_k"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
        .where(F.col("_o0").isNotNull() & F.col("_o1").isNotNull())
        .groupBy("_k")
        .agg(F.min(F.struct(*[f"_o{i}" for i in range(len(order))])).alias("_s"))
        .select(F.col("_k").alias(key), *[F.col(f"_s._o{i}").alias(c) for i, c in enumerate(order)])
    )


class _Shard:
    """One partition's state: a tree per group, what eviction sealed, what was last published."""

    def __init__(self, period: int, slot: int) -> None:
        self.slot, self.width = slot, period // slot
        self.trees: dict[str | None, FingerBTree] = defaultdict(FingerBTree)
        self.sealed: dict[tuple, list[int]] = {}
        self.published: dict[tuple, tuple[int, int]] = {}
        self.touched: set[tuple] = set()

    def insert(self, group: str | None, slot: int, amount: int, count: int, floor: int, closed: int) -> int:
        """What the group's tree says to a partial, with the cut-off and what is closed as it comes."""
        tree = self.trees[group]
        tree.cut_off(floor)
        tree.close(closed)
        told = tree.insert(slot, amount, count)
        if told != REFUSED:
            self.touched.add((group, slot // self.width))
        return told

    def publish(self, tick: int) -> Iterator[tuple]:
        """The change of every touched (group, period) since it was last published."""
        for g, p in sorted(self.touched, key=lambda x: (x[0] is not None, x[0] or "", x[1])):
            a, n = self.trees[g].range(p * self.width, (p + 1) * self.width) if g in self.trees else (0, 0)
            sealed = self.sealed.get((g, p), (0, 0))
            now = (a + sealed[0], n + sealed[1])
            before = self.published.get((g, p), (0, 0))
            self.published[g, p] = now
            if now != before:
                yield ("revision", None, g, p, tick, now[0] - before[0], now[1] - before[1], None)
        self.touched.clear()

    def evict(self, floor: int) -> None:
        """Drops the slots below ``floor``, period by period, by the totals of their subtrees; a period
        wholly below is forgotten."""
        for g, tree in list(self.trees.items()):
            while tree.least is not None and tree.least < floor:
                p = tree.least // self.width
                a, n = tree.evict_below(min(floor, (p + 1) * self.width))
                sealed = self.sealed.setdefault((g, p), [0, 0])
                sealed[0] += a
                sealed[1] += n
            if tree.least is None:
                del self.trees[g]
        done = floor // self.width
        for state in (self.sealed, self.published):
            for k in [k for k in state if k[1] < done]:
                del state[k]


def _sums(amounts: pa.Array, order: np.ndarray, starts: np.ndarray) -> list[int]:
    """Exact sums of 128-bit numbers over runs of ``order``: four limbs, added apart."""
    whole = amounts.fill_null(0)
    limbs = np.frombuffer(whole.buffers()[1], dtype=np.uint32).reshape(-1, 4)[whole.offset : whole.offset + len(whole)].astype(np.int64)
    limbs[:, 3] -= (limbs[:, 3] >> 31) << 32  # the sign
    added = np.add.reduceat(limbs[order], starts, axis=0).tolist()
    return [a + (b << 32) + (c << 64) + (d << 96) for a, b, c, d in added]


def _shards(lateness: int, period: int, slot: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tick = _Shard(period, slot), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows: list[tuple] = []
            arrival = np.asarray(batch.column(2).cast(pa.timestamp("us")).cast(pa.int64()))
            event = np.asarray(batch.column(3).cast(pa.timestamp("us")).cast(pa.int64()))
            groups = batch.column(1).dictionary_encode()
            names = [*groups.dictionary.to_pylist(), None]
            group = np.asarray(groups.indices.fill_null(len(names) - 1)).astype(np.int64)
            come, slots = arrival // slot, event // slot
            floors = (arrival - lateness) // slot
            # in the slot that the horizon cuts, the record's own time decides
            beyond = (slots == floors) & (event < arrival - lateness)
            order = np.lexsort((beyond, slots, group, come))
            key = np.stack([come, group, slots, beyond])[:, order]
            starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            counts = np.diff(np.r_[starts, len(order)]).tolist()
            told = np.zeros(len(starts), dtype=np.int8)
            firsts = order[starts]
            partials = zip(group[firsts].tolist(), slots[firsts].tolist(), floors[firsts].tolist(), beyond[firsts].tolist(), arrival[firsts].tolist(), _sums(batch.column(4), order, starts), counts, strict=True)
            for i, (g, s, floor, out, at, amount, count) in enumerate(partials):
                now = at // every
                if now != tick:
                    if tick is not None:
                        rows.extend(shard.publish(tick))
                        shard.evict(floor)
                    tick = now
                told[i] = REFUSED if out else shard.insert(names[g], s, amount, count, floor, at // period * shard.width)
            yield _batch(rows)
            outcome = np.empty(len(order), dtype=np.int8)
            outcome[order] = np.repeat(told, counts)
            yield _outcomes(batch, outcome, event // period, arrival // every)
        if tick is not None:
            yield _batch(list(shard.publish(tick)))

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _outcomes(batch: pa.RecordBatch, told: np.ndarray, periods: np.ndarray, ticks: np.ndarray) -> pa.RecordBatch:
    """The records that came after their period was closed, with what the tree said."""
    at = np.flatnonzero(told)
    take = pa.array(at)
    kinds = pa.array(["outcome"], pa.string()).take(pa.array(np.zeros(len(at), dtype=np.int64)))
    words = pa.array(["corrects", "cut_off"], pa.string()).take(pa.array((told[at] == REFUSED).astype(np.int64)))
    return pa.RecordBatch.from_arrays(
        [kinds, batch.column(0).take(take).cast(pa.string()), batch.column(1).take(take).cast(pa.string()), pa.array(periods[at]), pa.array(ticks[at]), pa.nulls(len(at), pa.decimal128(38, 0)), pa.nulls(len(at), pa.int64()), words], schema=_ARROW
    )


def late_event_log(df: DataFrame, key: str, event: str, arrival: str, group: str, amount: str, lateness_hours: int = 72, period_us: int = DAY_US, slot_us: int = 60_000_000, scale: int = 2, publish_us: int | None = None) -> DataFrame:
    """The log of the trees: ``outcome`` rows for records that came after their period ended, and
    ``revision`` rows with the change that a publication (``tick``) makes to a (group, period).

    Every key counts once, by its first delivery. A record later than the lateness is ``cut_off`` and
    enters no aggregate; equality still counts. Amounts are exact: fixed point with ``scale`` places,
    null, not-a-number and what 38 digits can't hold as 0 (``unfit_amounts`` counts the latter two).
    Publications follow each ``publish_us`` of arrival time, a period long if left out. Lateness, period
    and publications must be multiples of ``slot_us``.
    """
    lateness_us = lateness_hours * 3_600_000_000
    if period_us % slot_us or (publish_us or period_us) % slot_us or lateness_us % slot_us:
        raise ValueError("lateness, period_us and publish_us must be multiples of slot_us")
    value = F.col(amount).cast("double")
    fixed = F.when(~F.isnan(value), value).try_cast(f"decimal(38,{scale})")
    ensure_importable(df.sparkSession)
    firsts = first_deliveries(df, key, event, arrival, [group, amount])
    return (
        firsts.select(
            F.col(key).alias("_k"),
            F.col(group).cast("string").alias("_g"),
            F.col(arrival).cast("timestamp_ntz").alias("_a"),
            F.col(event).cast("timestamp_ntz").alias("_e"),
            (fixed * F.lit(10**scale)).try_cast("decimal(38,0)").alias("_v"),
        )
        .sortWithinPartitions("_a", "_e", "_k")
        .mapInArrow(_shards(lateness_us, period_us, slot_us, publish_us or period_us), _OUT)
    )


def unfit_amounts(df: DataFrame, amount: str, scale: int = 2) -> DataFrame:
    """One row: how many amounts are not-a-number, infinite or beyond 38 digits and enter sums as 0."""
    value = F.col(amount).cast("double")
    held = F.when(~F.isnan(value), value).try_cast(f"decimal(38,{scale})") * F.lit(10**scale)
    return df.agg(F.count_if(value.isNotNull() & held.try_cast("decimal(38,0)").isNull()).alias("unfit_amounts"))


def late_outcomes(df: DataFrame, key: str, event: str, arrival: str, group: str, amount: str, lateness_hours: int = 72) -> DataFrame:
    """(record_key, order_day, outcome) of every record that came after its day."""
    log = late_event_log(df, key, event, arrival, group, amount, lateness_hours)
    return log.where("kind = 'outcome'").select("record_key", _day("period").alias("event_day"), "outcome")


def period_revisions(df: DataFrame, key: str, event: str, arrival: str, group: str, amount: str, lateness_hours: int = 72, scale: int = 2, publish_us: int = DAY_US) -> DataFrame:
    """What each publication made of each (event day, group): the totals after it.

    Publications of one (group, period) are few: those within the lateness, or one for a clock set
    ahead. ``published_day`` is the day of arrival; shorter intervals add ``published_at``, their start.
    """
    log = late_event_log(df, key, event, arrival, group, amount, lateness_hours, scale=scale, publish_us=publish_us)
    change = log.where("kind = 'revision'").groupBy("period", "grp", "tick").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    so_far = Window.partitionBy("period", "grp").orderBy("tick")
    out = change.withColumn("_at", F.col("tick") * F.lit(publish_us)).select(
        "_at",
        _day("period").alias("event_day"),
        F.col("grp").alias("group_key"),
        F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("_at") / F.lit(DAY_US)).cast("int")).alias("published_day"),
        (F.sum("amount").over(so_far) / F.lit(10**scale)).cast("double").alias("total_amount"),
        F.sum("n").over(so_far).alias("record_count"),
        (F.row_number().over(so_far) - 1).alias("revision"),
    )
    if publish_us % DAY_US:
        out = out.withColumn("published_at", F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("_at") / F.lit(1e6)).cast("decimal(18,6)")))
    return out.drop("_at")


def _day(days_since_epoch: str):
    return F.date_add(F.lit("1970-01-01").cast("date"), F.col(days_since_epoch).cast("int"))
