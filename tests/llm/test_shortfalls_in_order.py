"""p7_found comes from the placed copies in the order of training."""

from conftest import rows
from oracle import compare, connect
from pyspark.sql import functions as F

from weir.llm import catalog, mixing

SCHEMA = "mix_id int, source string, share_permille int, max_repeats int, budget_percent int"


def _tables(spark, folder):
    docs = [(i, s, "x" * n) for i, (s, n) in enumerate([("a", 10), (" A ", 20), ("a", 30), ("b", 40), (None, 50), ("b", 0), ("c", 50), ("empty", 0)])]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(f"{folder}/documents.parquet")
    targets = [(1, "a", 600, 2, 100), (1, "b", 400, 2, 100), (2, "a", 601, 2, 100), (2, " A", 600, 2, 100), (2, "A", 601, 2, 100), (2, "none", 399, 9, 100), (3, "b", 405, 2, 99), (4, "c", 0, 1, 100), (4, "c", 1, 0, 100), (4, "empty", 5, 3, 10), (4, None, 5, 3, 10), (None, "a", 999, 1, 100), (5, "b", None, 1, 100), (5, "b", 900, None, 100)]
    spark.createDataFrame(targets, SCHEMA).write.parquet(f"{folder}/mix_targets.parquet")
    return folder


def test_every_target_against_sql(spark, tmp_path):
    folder = _tables(spark, str(tmp_path))
    con = connect(folder)
    for name in ("documents", "mix_targets"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    compare(catalog.p7_found(spark, folder), con, catalog.ORACLES["p7_found"])


def test_copies_that_are_not_placed_are_not_used_up(spark, tmp_path, monkeypatch):
    folder = _tables(spark, str(tmp_path))
    want = rows(catalog.p7_found(spark, folder))
    placed = mixing._copies
    monkeypatch.setattr(mixing, "_copies", lambda *a: placed(*a).where("copy_no = 1"))
    have = rows(catalog.p7_found(spark, folder))
    assert (2, "a") in want and (2, "a") not in have and (None, "a") in have


def test_the_last_copy_in_order_decides(spark, tmp_path, monkeypatch):
    folder = _tables(spark, str(tmp_path))
    monkeypatch.setattr(mixing, "invert_linear", lambda fraction, drift: 1 - fraction)  # the training runs backwards
    df, targets = catalog._mix(spark, folder)
    short = targets.where("mix_id is null")
    plan = mixing.placed_shortfalls(df, short, "doc_id", "source", mixing.utf8_tokens(F.col("text")))
    monkeypatch.setattr(mixing, "shortfalls", lambda plan, drift, supplied: plan.select(supplied.alias("at")))
    first = mixing.placed_shortfalls(df, short, "doc_id", "source", mixing.utf8_tokens(F.col("text"))).first()["at"] / 100_000
    assert plan.count() == 1 and 0 < first < 60  # backwards, the last copy is the one at the start of the axis


def test_the_plan_sorts_by_ranges(spark, small):
    plan = catalog.p7_found(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(mix_id" in plan and "position" in plan and "monotonically_increasing_id" in plan
