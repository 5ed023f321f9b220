"""Problems 1, 2, 4 and 5: brute force, edge cases, skew."""

import math
import random
from datetime import datetime, timedelta

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weir.functions.masks import number_mask, value_mask
from weir.operators import late_events, orphans, profile, schema_fold
from weir.operators.finger_tree import LATE, REFUSED, TAKEN, FingerBTree

T0 = datetime(2024, 10, 1)
EVENT = {"key": "k", "event": "e", "arrival": "a", "group": "g", "amount": "v"}
EVENTS = "k string, e timestamp_ntz, a timestamp_ntz, g string, v double"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_finger_tree_against_dict(seed):
    r, tree, held, top = random.Random(seed), FingerBTree(), {}, 0
    floor = closed = 0
    for _ in range(400):
        step = r.random()
        if step < 0.8:
            top += r.randint(0, 3)
            key, amount = (top if r.random() < 0.6 else max(0, top - r.randint(0, 300))), r.randint(-5, 9)
            closed = max(closed, top - r.randint(0, 400))
            tree.close(closed)
            told = tree.insert(key, amount)
            assert told == (REFUSED if key < floor else LATE if key < closed else TAKEN)
            if told == REFUSED:
                continue
            held.setdefault(key, [0, 0])
            held[key][0] += amount
            held[key][1] += 1
        elif step < 0.93:
            low = r.randint(0, top + 5)
            high = low + r.randint(0, 200)
            inside = [v for k, v in held.items() if low <= k < high]
            assert tree.range(low, high) == (sum(v[0] for v in inside), sum(v[1] for v in inside))
        else:
            low = max(0, top - r.randint(-5, 200))
            gone = [held.pop(k) for k in sorted(held) if k < low]
            assert tree.evict_below(low) == (sum(v[0] for v in gone), sum(v[1] for v in gone))
            floor = max(floor, low)
    assert tree.total == (sum(v[0] for v in held.values()), sum(v[1] for v in held.values()))


def test_late_outcomes_and_edges(spark):
    h = timedelta(hours=1)
    data = [
        ("on_time", T0, T0 + h, "USD", 1.0),
        ("next_day", T0 + 23 * h, T0 + 25 * h, "USD", 2.0),
        ("at_limit", T0, T0 + 72 * h, "USD", 4.0),
        ("too_late", T0, T0 + 72 * h + timedelta(microseconds=1), "USD", 8.0),
        ("future", T0 + 900 * h, T0, None, float("nan")),
        ("twice", T0, T0 + 30 * h, "USD", 16.0),
        ("twice", T0, T0 + 2 * h, "USD", 32.0),
        ("tie", T0 + h, T0 + 26 * h, "EUR", None),
        ("tie", T0 + 25 * h, T0 + 26 * h, "EUR", 1.0),
        ("no_event", None, T0, "USD", 1.0),
        ("no_arrival", T0, None, "USD", 1.0),
        (None, T0, T0 + 40 * h, "USD", 64.0),
        ("huge", T0, T0, "USD", 1e300),
    ]
    df = spark.createDataFrame(data, EVENTS).withColumn("_k", F.lit(1)).withColumn("kind", F.lit("x"))
    out = {r[0]: (str(r[1]), r[2]) for r in late_events.late_outcomes(df, **EVENT).collect()}
    assert out == {"next_day": ("2024-10-01", "corrects"), "at_limit": ("2024-10-01", "corrects"), "too_late": ("2024-10-01", "cut_off"), "tie": ("2024-10-01", "corrects"), None: ("2024-10-01", "corrects")}
    last = {}
    for r in late_events.period_revisions(df, **EVENT).orderBy("published_day").collect():
        last[str(r["event_day"]), r["group_key"]] = (r["total_amount"], r["record_count"])
    assert last["2024-10-01", "USD"] == (1.0 + 2 + 4 + 32 + 64, 6)
    assert last["2024-10-01", "EUR"] == (0.0, 1)
    assert last["2024-11-07", None] == (0.0, 1)
    assert late_events.late_outcomes(df.limit(0), **EVENT).count() == 0


def test_outcomes_are_the_answers_of_the_tree(monkeypatch):
    """A tree that never closes and never cuts off leaves no outcome (but in the slot of the horizon)."""
    h = 3_600_000_000
    times = pa.array([T0 + timedelta(hours=x) for x in (2, 26, 80, 200)], pa.timestamp("us"))
    events = pa.array([T0, T0, T0 + timedelta(hours=1), T0], pa.timestamp("us"))
    batch = pa.record_batch([pa.array(["a", "b", "c", "d"]), pa.array(["g"] * 4), times, events, pa.array([1, 2, 3, -4], pa.decimal128(38, 0))], names=list("kgaev"))

    def told():
        out = pa.Table.from_batches(list(late_events._shards(72 * h, 24 * h, 60_000_000, 24 * h)(iter([batch])))).to_pylist()
        return {x["record_key"]: x["outcome"] for x in out if x["kind"] == "outcome"}, sum(x["n"] for x in out if x["kind"] == "revision")

    assert told() == ({"b": "corrects", "c": "cut_off", "d": "cut_off"}, 2)
    monkeypatch.setattr(FingerBTree, "close", lambda self, below: None)
    monkeypatch.setattr(FingerBTree, "cut_off", lambda self, low: None)
    assert told() == ({}, 4)


def test_sums_of_large_amounts_are_exact(spark):
    r = random.Random(2)
    values = [r.choice([-1, 1]) * r.randint(0, 10 ** r.randint(1, 37)) for _ in range(500)]
    order = np.array(sorted(range(500), key=lambda i: i % 7))
    starts = np.flatnonzero(np.r_[True, np.diff(order % 7) != 0])
    found = late_events._sums(pa.array(values, pa.decimal128(38, 0)), order, starts)
    assert found == [sum(v for i, v in enumerate(values) if i % 7 == k) for k in range(7)]
    df = spark.createDataFrame([(v,) for v in (1.0, None, float("nan"), float("inf"), 1e300, -5.0)], "v double")
    assert late_events.unfit_amounts(df, "v").first()[0] == 3


def test_late_events_published_by_the_hour(spark):
    h = timedelta(hours=1)
    data = [("a", T0, T0 + h / 2, "g", 1.0), ("b", T0, T0 + h / 4, "g", 2.0), ("c", T0, T0 + 5 * h, "g", 4.0), ("d", T0, T0 + 30 * h, "h", 8.0)]
    out = late_events.period_revisions(spark.createDataFrame(data, EVENTS), **EVENT, publish_us=3_600_000_000)
    found = sorted((r["published_at"], r["group_key"], r["total_amount"], r["revision"]) for r in out.collect())
    assert found == [(T0, "g", 3.0, 0), (T0 + 5 * h, "g", 7.0, 1), (T0 + 30 * h, "h", 8.0, 0)]


def test_late_events_one_key_and_group_hold_most_rows(spark):
    r = random.Random(5)
    data = [("hot" if i % 3 == 0 else f"k{i}", T0 + timedelta(minutes=r.randint(0, 9000)), T0 + timedelta(minutes=r.randint(0, 20000)), "USD", 1.0) for i in range(3000)]
    out = late_events.period_revisions(spark.createDataFrame(data, EVENTS).repartition(7), **EVENT)
    first = {}
    for k, e, a, *_ in data:
        first[k] = min(first.get(k, (a, e)), (a, e))
    taken = [(a, e) for a, e in first.values() if a - e <= timedelta(hours=72)]
    final = {}
    for row in out.orderBy("published_day").collect():
        final[row["event_day"]] = row["record_count"]
    want = {}
    for _, e in taken:
        want[e.date()] = want.get(e.date(), 0) + 1
    assert final == want


SPECS = "column_name string, value_pattern string, min_value double, max_value double"


def issues(df, specs, order, distinct, shift, columns):
    declared = specs.collect()
    masks = profile.mask_counts(df, F.col("load"), columns, declared)
    return {tuple(r) for r in profile.load_issues(masks, profile.value_histogram(df, F.col("load"), columns), declared, order, distinct, shift).collect()}


def order_of(df):
    return profile.load_order(df.where("trim(load) <> ''").select(F.col("load").alias("load_id"), F.lit("s").alias("stream")).distinct(), "stream", ["load_id"])


@pytest.fixture(scope="module")
def two_loads(spark):
    good = [("f/load_1", f"CUST-{i:07d}", "x") for i in range(50)]
    bad = [("f/load_2", None if i < 15 else "" if i < 20 else f"cust{i % 3}", "y") for i in range(50)]
    df = spark.createDataFrame([*good, *bad, (None, "zz", "q"), (" ", "zz", "q")], "load string, customer_id string, rule_name string").withColumn("n", F.lit(5)).withColumn("mask", F.lit("m"))
    return df, spark.createDataFrame([("customer_id", "CUST-[0-9]{7}", None, None)], SPECS)


def test_profile_issues(two_loads):
    df, specs = two_loads
    found = issues(df, specs, order_of(df), ["customer_id"], ["rule_name"], ["customer_id", "rule_name"])
    assert found == {("customer_id", "f/load_2", "nulls"), ("customer_id", "f/load_2", "pattern"), ("customer_id", "f/load_2", "distinct"), ("rule_name", "f/load_2", "shift")}
    assert issues(df.limit(0), specs, order_of(df), ["customer_id"], ["rule_name"], ["customer_id", "rule_name"]) == set()
    profiled = profile.column_profile(profile.mask_counts(df, F.col("load"), ["customer_id"], []), [])
    assert {r["load_id"]: r["dominant_mask"] for r in profiled.collect()} == {"f/load_1": "A-9999999", "f/load_2": "a9"}


def test_masks_decide(two_loads, monkeypatch):
    """With masks that tell nothing apart, no value is off the pattern."""
    df, specs = two_loads
    monkeypatch.setattr(profile, "pattern_mask", lambda text, pattern: F.when(text.isNotNull(), F.lit("CUST-0000000")))
    found = issues(df, specs, order_of(df), ["customer_id"], ["rule_name"], ["customer_id", "rule_name"])
    assert ("customer_id", "f/load_2", "pattern") not in found and ("customer_id", "f/load_2", "nulls") in found


def test_values_settle_what_masks_do_not_show(spark):
    """Values move within one mask; and masks that moved need no look at values."""
    data = [("l1", "aa", "aa")] * 10 + [("l2", "bb", "9")] * 10
    df = spark.createDataFrame(data, "load string, c string, d string")
    assert issues(df, spark.createDataFrame([], SPECS), order_of(df), [], ["c", "d"], ["c", "d"]) == {("c", "l2", "shift"), ("d", "l2", "shift")}
    masks = profile.mask_counts(df, F.col("load"), ["c", "d"], [])
    empty = profile.value_histogram(df.limit(0), F.col("load"), ["c", "d"])
    totals = profile.column_profile(masks, [])
    assert [tuple(r) for r in profile.shifted(masks, empty, totals, order_of(df), 0.5).collect()] == [("l2", "d")]


def test_shares_at_the_bound_are_no_issue(spark):
    df = spark.createDataFrame([("l", None if i < 4 else "a") for i in range(20)], "load string, c string")
    specs = spark.createDataFrame([("c", "b", None, None)], SPECS)
    assert {x[2] for x in issues(df, specs, order_of(df), [], [], ["c"])} == {"pattern"}


def test_half_of_odd_shares_is_no_shift(spark):
    """Shares of 3, 7 and 49 rows whose differences add up to one half, no more."""
    for n in (3, 7, 49):
        data = [("l1", f"v{i}") for i in range(n) for _ in range(2)] + [("l2", f"v{i}" if i < n else f"w{i}") for i in range(2 * n)]
        df = spark.createDataFrame(data, "load string, c string")
        assert issues(df, spark.createDataFrame([], SPECS), order_of(df), [], ["c"], ["c"]) == set()


@pytest.mark.parametrize("pattern", ["^CUST-[0-9]{7}$", "^[a-z]+(_[a-z]+)+$", r"\w+[.]\\d*", "[^0-9]*", "(a|bc)+x?", r"(.)\\1", "(?i)abc", r"\p{L}+ \\$", ".*", "a$", "é+"])
def test_a_mask_matches_its_pattern_as_its_values_do(spark, pattern):
    r = random.Random(1)
    pieces = ["CUST-", "cust", "1234567", "7", "_", "ab", "bc", "x", ".", "\n", "\r\n", "é", "字", "😀", " ", "$", "\\", "A", "\u2028"]
    values = [("".join(r.choice(pieces) for _ in range(r.randint(1, 4))),) for _ in range(400)] + [("CUST-1234567",), ("silver_orders_x",), ("aa",), ("",)]
    whole = F.lit(rf"\A(?:{pattern})\z")
    df = spark.createDataFrame(values, "v string").select("v", F.regexp_like("v", whole).alias("own"), F.regexp_like(profile.pattern_mask(F.col("v"), pattern), whole).alias("mask"))
    assert df.where("own <> mask").count() == 0


def test_table_profile(spark):
    data = [("l", i, float("nan") if i < 3 else i / 2, None if i % 2 else f"v{i}", T0 + timedelta(seconds=i)) for i in range(40)] + [(None, 1, 1.0, "x", T0)]
    df = spark.createDataFrame(data, "load string, i int, d double, s string, t timestamp_ntz").withColumn("m", F.create_map(F.lit("a"), "i"))
    found = {r["column_name"]: r for r in profile.table_profile(profile.mask_histogram(df, F.col("load"), ["i", "d", "s", "t", "m"])).collect()}
    assert set(found) == {"i", "d", "s", "t", "m"} and all(r["row_count"] == 40 for r in found.values())
    assert (found["d"]["null_count"], found["d"]["min_number"], found["d"]["max_number"]) == (3, 1.5, 19.5)
    assert (found["s"]["null_count"], found["s"]["min_length"], found["s"]["max_length"], found["s"]["dominant_mask"], found["s"]["dominant_count"]) == (20, 2, 3, "a99", 15)
    assert found["t"]["max_number"] - found["t"]["min_number"] == 39e6
    assert abs(found["i"]["distinct_estimate"] - 40) <= 6
    assert profile.mask_histogram(df.limit(0), F.col("load"), ["i"]).count() == 0


def test_masks_of_numbers_are_those_of_their_text(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, -0.0, 1.5, -2e-9, 1e300, 12345678.9, math.inf, -math.inf, None)], "v double").select(F.col("v").cast("string").alias("t"))
    assert df.where(~number_mask(F.col("t")).eqNullSafe(value_mask(F.col("t")))).count() == 0


def test_masks_of_odd_values(spark):
    masks = profile.value_histogram(spark.createDataFrame([("l", v) for v in ("Ab-12", "ÄÖ x\t\ty", "a" * 100_000, "  ")], "load string, c string"), F.col("load"), ["c"])
    assert {r["mask"] for r in masks.collect()} == {"Aa-99", "u a a", "a", None}


def brute_orphans(references, history):
    out = []
    for name, table, key, at in references:
        if None in (table, key, at):
            continue
        changes = sorted({(t, kind) for tb, k, kind, t in history if (tb, k) == (table, key)})
        before = [c for c in changes if c[0] <= at]
        state = "missing" if not changes else "late" if changes[0][0] > at else "deleted" if before[-1][1] == "deleted" else None
        if state:
            out.append((name, state))
    return sorted(out, key=repr)


def test_orphans_against_brute_force(spark):
    r = random.Random(11)
    history, references = [], []
    for i in range(40):
        at, kind = T0 + timedelta(hours=r.randint(0, 200)), "created"
        for _ in range(r.choice([1, 1, 2, 3, 4])):
            history.append(("t", f"K{i}", kind, at))
            kind, at = ("deleted" if kind != "deleted" else "restored"), at + timedelta(hours=r.choice([1, 2, 30]), minutes=r.randint(0, 59))
    history += history[:10]
    for i in range(900):
        key = "K0" if i % 3 == 0 else f"K{r.randint(0, 45)}"
        references.append((f"r{i}", "t", key, T0 + timedelta(hours=r.randint(-30, 320), minutes=r.randint(0, 59))))
    references += [("same", "t", history[0][1], history[0][3]), ("n1", "t", None, T0), ("n2", None, "K1", T0), ("n3", "t", "K1", None), (None, "t", "NONE", T0)]
    refs = spark.createDataFrame(references, "name string, ref_table string, ref_key string, at timestamp_ntz").withColumn("day", F.lit("x")).withColumn("state", F.lit(1)).withColumn("alive", F.lit(9))
    changes = orphans.existence_changes(spark.createDataFrame([*history, ("t", None, "created", T0)], "tb string, k string, kind string, ts timestamp_ntz"), "tb", "k", "kind", "ts")
    found = orphans.orphan_references(refs, changes, ["name"])
    assert sorted(((x["name"], x["key_state"]) for x in found.collect()), key=repr) == brute_orphans(references, history)
    assert orphans.orphan_references(refs.limit(0), changes, ["name"]).count() == 0
    assert orphans.orphan_references(refs, changes.limit(0), ["name"]).where("key_state <> 'missing'").count() == 0


def test_the_ledger_is_carried_from_day_to_day(spark):
    """Balances of the first days and the deltas of the rest are those of all days; so are the orphans."""
    r = random.Random(5)
    history, references = [], []
    for i in range(30):
        at, kind = T0 + timedelta(hours=r.randint(0, 150)), "created"
        for _ in range(r.choice([1, 2, 3, 4])):
            history.append(("t", f"K{i}", kind, at))
            kind, at = ("deleted" if kind != "deleted" else "restored"), at + timedelta(hours=r.randint(1, 90))
    references = [(f"r{i}", "t", "K1" if i % 3 == 0 else f"K{r.randint(0, 36)}", T0 + timedelta(hours=r.randint(0, 300))) for i in range(500)]
    middle = T0 + timedelta(days=5)
    refs = spark.createDataFrame(references, "name string, ref_table string, ref_key string, at timestamp_ntz")
    changes = orphans.existence_changes(spark.createDataFrame(history, "tb string, k string, kind string, ts timestamp_ntz"), "tb", "k", "kind", "ts")
    first, rest = F.col("at") < F.lit(middle), F.col("at") >= F.lit(middle)
    opening = orphans.carry(None, orphans.key_deltas(refs.where(first), changes.where(first)))
    whole = orphans.carry(None, orphans.key_deltas(refs, changes))
    later = orphans.existence_changes(spark.createDataFrame([h for h in history if h[3] >= middle], "tb string, k string, kind string, ts timestamp_ntz"), "tb", "k", "kind", "ts", opening)
    assert rows(later) == rows(changes.where(rest))
    carried = orphans.carry(opening, orphans.key_deltas(refs.where(rest), later))
    assert rows(carried) == rows(whole)
    state = {}
    for _, k, kind, at in sorted(history, key=lambda x: x[3]):
        state[k] = kind
    want = {}
    for _, _, k, _ in references:
        if state.get(k, "deleted") == "deleted":
            want[k] = (want.get(k, (0, ""))[0] + 1, "deleted" if k in state else "missing")
    assert {x["ref_key"]: (x["refs"], x["key_state"]) for x in orphans.orphan_keys(whole).collect()} == want
    withdrawn = refs.withColumn("delta", F.lit(-1))
    assert orphans.orphan_keys(orphans.carry(whole, orphans.key_deltas(withdrawn, changes.limit(0)))).count() == 0
    late = orphans.orphan_references(refs.where(rest), changes.where(rest), ["name"], opening=opening)
    seen = {n for n, _, k, at in references if at >= middle}
    assert {x["name"]: x["key_state"] for x in late.collect()} == {n: s for n, s in brute_orphans(references, history) if n in seen}


def test_a_hot_key_that_changes_within_the_day_is_never_sorted(spark):
    """Half of all references name one key on the day it changes: no window or sort over them."""
    history = [("t", "HOT", "created", T0), ("t", "HOT", "deleted", T0 + timedelta(hours=6)), ("t", "HOT", "restored", T0 + timedelta(hours=7))]
    references = [(f"r{i}", "t", "HOT" if i % 2 else f"K{i}", T0 + timedelta(minutes=i % 1000)) for i in range(4000)]
    refs = spark.createDataFrame(references, "name string, ref_table string, ref_key string, at timestamp_ntz")
    changes = orphans.existence_changes(spark.createDataFrame(history, "tb string, k string, kind string, ts timestamp_ntz"), "tb", "k", "kind", "ts")
    found = orphans.orphan_references(refs, changes, ["name"])
    assert sorted((x["name"], x["key_state"]) for x in found.collect()) == brute_orphans(references, history)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


LINES = "file_id bigint, feed string, file_seq int, fmt string, line_no int, raw_line string"


def test_layout_changes_of_the_small_table(spark, small):
    path = f"{small}/raw_order_files.parquet"
    data = duckdb.sql(f"SELECT file_id, feed, file_seq, fmt, line_no, raw_line FROM '{path}'").fetchall()
    found = schema_fold.layout_changes(spark.read.parquet(path)).select("file_id", "field_name", "change_kind")
    assert {tuple(r) for r in found.collect()} == brute.layout_changes(data)


def test_layout_changes_of_hand_made_files(spark):
    head = "order_id,customer_id,product_id,order_status,quantity,unit_price,currency,order_timestamp"
    body = "ORD-1,CUST-1,PROD-1,shipped,2,1.5,USD,2024-10-01 00:00:00"
    data = [
        (1, "a", 1, "csv", 1, head), (1, "a", 1, "csv", 2, body), (1, "a", 1, "csv", 2, body),
        (2, "a", 3, "csv", 1, head.replace(",quantity", ", QTY ").replace(",", ";")), (2, "a", 3, "csv", 2, body.replace(",", ";").replace(";2;", ";;")),
        (3, "a", 4, "json", 1, '{"order_id": "ORD-1", "qty": "2 pcs", "unit_price": 3, "currency": 840, "note": "a, \\"b\\": 1", "flag": null}'),
        (4, "a", 5, "json", 1, '{"order_id": "ORD-1", "qty": 2, "unit_price": 3.0, "currency": 840, "flag": true}'),
        (5, "b", 1, "csv", 1, head), (6, None, 1, "csv", 1, head), (None, "a", 9, "csv", 1, head), (7, "c", 1, "csv", 1, None), (8, "c", 2, "json", 1, ""),
    ]
    df = spark.createDataFrame(data, LINES).withColumn("names", F.lit("x")).withColumn("_sep", F.lit(1))
    found = {tuple(r) for r in schema_fold.layout_changes(df).select("file_id", "field_name", "change_kind").collect() if r[0] < 7}
    removed = {(3, f, "removed") for f in ("customer_id", "product_id", "order_status", "order_timestamp")}
    assert found == removed | {
        (2, "quantity", "renamed"), (3, "quantity", "retyped"), (3, "unit_price", "retyped"), (3, "currency", "retyped"), (3, "note", "added"), (3, "flag", "added"),
        (4, "quantity", "retyped"), (4, "unit_price", "retyped"), (4, "note", "removed"),
    }
    assert schema_fold.layout_changes(df.limit(0)).count() == 0
    records = {r["file_id"]: r for r in schema_fold.read_consistent(df).collect()}
    assert set(records) == {1, 2, 3, 4}
    assert (records[1]["quantity"], records[2]["quantity"], records[3]["quantity"], records[4]["unit_price"], records[4]["flag"]) == ("2", None, "2 pcs", 3.0, True)
    assert records[3]["note"] == 'a, "b": 1'
