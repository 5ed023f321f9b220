"""p7_found rests on the placed documents."""

from conftest import rows
from pyspark.sql import functions as F

from weir.llm import catalog, mixing


def test_rows_follow_the_token_axis(spark, monkeypatch):
    docs = [(i, s, "x" * n) for i, (s, n) in enumerate([("a", 10), (" A ", 20), ("a", 30), ("b", 40), (None, 50), ("b", 0), ("c", 50)])]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([(1, "a", 600, 2, 100), (1, "b", 400, 2, 100), (2, "a", 601, 2, 100), (2, "none", 399, 9, 100), (3, "b", 405, 2, 99), (4, "c", 0, 1, 100)], "mix_id int, source string, share_permille int, max_repeats int, budget_percent int")
    tokens = mixing.utf8_tokens(F.col("text"))
    assert rows(mixing.placed_shortfalls(df, targets, "doc_id", "source", tokens)) == [(2, "a"), (2, "none"), (3, "b")]
    axis = mixing.token_offsets
    monkeypatch.setattr(mixing, "token_offsets", lambda *a: axis(*a).withColumn("begin", F.col("begin") + 1_000_000))
    assert mixing.placed_shortfalls(df, targets, "doc_id", "source", tokens).where("source <> 'none'").count() == 0


def test_query_places_documents(spark, small, monkeypatch):
    called = []
    axis = mixing.token_offsets
    monkeypatch.setattr(mixing, "token_offsets", lambda *a: called.append(1) or axis(*a))
    catalog.p7_found(spark, small)
    assert called
