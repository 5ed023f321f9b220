"""Mixes against plain loops."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weir.llm import mixing

TARGETS = "mix_id int, source string, share_permille int, max_repeats int, budget_percent int"


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(2)
    docs = [(i, r.choice(["big", " Big ", "BIG", "small", "tiny", None, ""]), "x" * r.randint(0, 50) if i % 11 else None) for i in range(600)]
    targets = [(1, "big", 500, 2, 80), (1, "small", 300, 3, 80), (1, "tiny", 200, 1, 80), (2, "big", 1000, 1, 10), (3, "absent", 400, 5, 50), (3, "small", 600, 1, 150)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").selectExpr("*", "1 AS tokens", "2 AS begin")
    return docs, df, targets, spark.createDataFrame(targets, TARGETS)


def size(text):
    return len(text or "")


def test_shortfalls(tables):
    docs, df, targets, given = tables
    total = sum(size(t) for *_, t in docs)
    own = {s: sum(size(t) for _, x, t in docs if x and x.strip().lower() == s) for _, s, *_ in targets}
    want = [(m, s) for m, s, share, rep, pct in targets if rep * own[s] * 100_000 < share * pct * total]
    plan = mixing.demand(given, mixing.supply(df, "source", mixing.utf8_tokens(F.col("text"))))
    assert rows(mixing.shortfalls(plan)) == sorted(want)
    assert rows(mixing.shortfalls(plan, F.lit(0.7))) == sorted(want)


@pytest.mark.parametrize("drift", [0.0, 0.6, -1.0])
def test_curriculum(tables, drift):
    docs, df, targets, given = tables
    tokens = mixing.utf8_tokens(F.col("text"))
    out = mixing.curriculum(df, given, "doc_id", "source", tokens, F.lit(drift)).collect()
    total = sum(size(t) for *_, t in docs)
    for m, s, share, rep, pct in targets:
        own = [x for x in out if (x["mix_id"], x["source"]) == (m, s)]
        sizes = {i: size(t) for i, x, t in docs if x and x.strip().lower() == s}
        supply, wanted = sum(sizes.values()), share * pct * total / 100_000
        given_tokens, biggest = min(wanted, rep * supply), max(sizes.values(), default=0)
        taken = sum(x["tokens"] for x in own)
        assert given_tokens - 1e-6 <= taken < given_tokens + biggest or not own
        assert max((x["copy_no"] for x in own), default=0) <= rep
        assert all(0 <= x["position"] <= 1 for x in own)
        assert len({(x["doc_id"], x["copy_no"]) for x in own}) == len(own)
        if drift == 0 and own:
            half = sum(x["tokens"] for x in own if x["position"] <= 0.5)
            assert abs(half - min(given_tokens, wanted / 2)) <= biggest
    order = [(x["mix_id"], x["position"]) for x in out]
    assert order == sorted(order)


def test_a_short_source_runs_out(tables):
    """Its copies end at exhausted_at instead of being spread over the whole training."""
    docs, df, _, _ = tables
    tokens = mixing.utf8_tokens(F.col("text"))
    short = df.sparkSession.createDataFrame([(9, "small", 1000, 1, 100)], TARGETS)
    plan = mixing.demand(short, mixing.supply(df, "source", tokens))
    for drift in (0.0, 0.6, -1.0):
        at = mixing.exhaustion(plan, F.lit(drift)).first()["exhausted_at"]
        last = mixing.curriculum(df, short, "doc_id", "source", tokens, F.lit(drift)).agg(F.max("position")).first()[0]
        assert 0 < at < 0.9 and at - 0.02 < last <= at
    lasting = df.sparkSession.createDataFrame([(9, "small", 10, 9, 10)], TARGETS)
    assert mixing.exhaustion(mixing.demand(lasting, mixing.supply(df, "source", tokens))).first()["exhausted_at"] is None


def test_later_weight_comes_later(tables):
    _, df, _, given = tables
    tokens = mixing.utf8_tokens(F.col("text"))
    mean = {d: mixing.curriculum(df, given.where("mix_id = 2"), "doc_id", "source", tokens, F.lit(d)).agg(F.avg("position")).first()[0] for d in (-0.8, 0.8)}
    assert mean[-0.8] < 0.45 < 0.55 < mean[0.8]  # 0.37 and 0.63 for many small documents


def test_empty(tables):
    _, df, _, given = tables
    tokens = mixing.utf8_tokens(F.col("text"))
    assert mixing.curriculum(df.limit(0), given, "doc_id", "source", tokens).count() == 0
    assert mixing.curriculum(df, given.limit(0), "doc_id", "source", tokens).count() == 0
    empty = mixing.demand(given, mixing.supply(df.limit(0), "source", tokens))
    assert mixing.shortfalls(empty).count() == 0 and empty.count() == given.count()


def test_shares(tables):
    _, df, _, given = tables
    tokens = mixing.utf8_tokens(F.col("text"))
    plan = mixing.demand(given, mixing.supply(df, "source", tokens))
    shares = mixing.actual_shares(mixing.curriculum(df, given, "doc_id", "source", tokens), plan).collect()
    assert len(shares) == given.count()
    for m in {x["mix_id"] for x in shares}:
        assert abs(sum(x["reached_permille"] for x in shares if x["mix_id"] == m) - 1000) < 0.1
