"""JSON as JSON, names by feed and content, the same answer for few and many files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weir.operators import schema_fold

LINES = "file_id bigint, feed string, file_seq int, fmt string, line_no int, raw_line string"
FIELDS = list(schema_fold.CONTRACT)


def record(r, **changes):
    row = {"order_id": f"ORD-{r.randint(1, 999999):08d}", "customer_id": f"CUST-{r.randint(1, 9999):07d}", "product_id": f"PROD-{r.randint(1, 99):03d}", "order_status": "shipped", "quantity": r.choice([2, 2, 3, 7, 12]), "unit_price": r.randint(100, 90000) / 100 + 0.001, "currency": "USD", "order_timestamp": "2024-10-01 00:00:00"}
    return {changes.get(k, k): v for k, v in row.items() if changes.get(k, k)}


def file(file_id, feed, seq, records):
    return [(file_id, feed, seq, "json", i + 1, json.dumps(x)) for i, x in enumerate(records)]


def changes(spark, data):
    found = schema_fold.layout_changes(spark.createDataFrame(data, LINES)).select("file_id", "field_name", "change_kind")
    return {tuple(x) for x in found.collect()}


@pytest.mark.parametrize("others", [0, 1, 6])
def test_a_rename_is_one_whatever_the_number_of_files(spark, others):
    r = random.Random(1)
    data = file(1, "a", 1, [record(r) for _ in range(25)]) + file(2, "a", 2, [record(r, quantity="menge") for _ in range(25)])
    for k in range(others):
        data += file(10 + k, "a", 3 + k, [record(r, quantity="menge") for _ in range(25)])
    data += file(90, "b", 1, [{**record(r), "menge": 4} for _ in range(25)])  # stands beside the field in another feed
    assert changes(spark, data) == {(2, "quantity", "renamed"), (90, "menge", "added")}


def test_other_numbers_are_no_rename(spark):
    r = random.Random(2)
    data = file(1, "a", 1, [record(r) for _ in range(25)])
    data += file(2, "a", 2, [{**record(r, quantity=None), "store_no": r.randint(1, 89)} for _ in range(25)])
    data += file(3, "a", 3, [{**record(r, quantity=None, unit_price=None), "store_no": r.randint(1, 89), "tarif": r.randint(100, 90000) / 100 + 0.001} for _ in range(25)])
    assert changes(spark, data) == {(2, "quantity", "removed"), (2, "store_no", "added"), (3, "unit_price", "renamed")}


def test_json_is_read_as_json(spark):
    base = {f: None for f in FIELDS}
    data = [
        (1, "a", 1, "json", 1, json.dumps({**base, "addr": {"currency": "EUR", "quantity": 4}, "tags": ["x", 1], "note": 'a\né\\ "q": 1'})),
        (1, "a", 1, "json", 2, json.dumps({**base, "quantity": 123456789012345678901, "unit_price": 0.12345678901, "currency": "USD", "note": "7"})),
        (1, "a", 1, "json", 3, "[1, 2]"), (1, "a", 1, "json", 4, '{"broken": '), (1, "a", 1, "json", 5, '"text"'),
    ]
    assert changes(spark, data) == {(1, f, "added") for f in ("addr", "tags", "note")}
    found = {x["line_no"]: x for x in schema_fold.read_consistent(spark.createDataFrame(data, LINES)).collect()}
    assert found[1]["currency"] is None and found[1]["addr"] == '{"currency":"EUR","quantity":4}' and found[1]["tags"] == '["x",1]'
    assert found[1]["note"] == 'a\né\\ "q": 1'
    assert found[2]["quantity"] is None and found[2]["unfit_fields"] == "quantity"  # beyond a long, and told so
    assert str(found[2]["unit_price"]) == "0.1234567890" and found[2]["note"] == "7"


def test_delimited_files(spark):
    head = ",".join(FIELDS)
    body = 'ORD-1,CUST-1,PROD-1,shipped,2,1.5,USD,"2024-10-01, 00:00:00"'
    data = [
        (1, "a", 1, "CSV ", 1, head + ",note"), (1, "a", 1, "csv", 2, body + ',"a; ""b"" | c"'), (1, "a", 1, "csv", 3, body.replace(",2,", ",,") + ",x,beyond"),
        (2, "a", 2, "csv", 1, (head + ",note").replace(",", "\t")), (2, "a", 2, "csv", 2, body.replace('"', "").replace(", ", " ").replace(",", "\t") + "\ta,b;c"),
        (3, "s", 1, "csv", 1, "order_id"), (3, "s", 1, "csv", 2, "ORD-7"),
    ]
    assert changes(spark, data) == {(1, "note", "added")} | {(3, f, "removed") for f in FIELDS[1:]}
    found = {(x["file_id"], x["line_no"]): x for x in schema_fold.read_consistent(spark.createDataFrame(data, LINES)).collect()}
    assert found[1, 2]["note"] == 'a; "b" | c' and found[1, 2]["order_timestamp"] == "2024-10-01, 00:00:00"
    assert found[1, 3]["quantity"] is None and found[2, 2]["note"] == "a,b;c" and found[3, 2]["order_id"] == "ORD-7"


def test_one_file_holds_most_rows(spark):
    r = random.Random(3)
    data = file(1, "a", 1, [record(r) for _ in range(3000)]) + file(2, "b", 1, [record(r) for _ in range(10)])
    shapes = schema_fold._cells(spark.createDataFrame(data, LINES)).groupBy("file_id", "place", schema_fold._shape(F.col("text"))).count()
    assert shapes.where("file_id = 1").count() < 120  # what is shuffled of 24,000 cells
    assert changes(spark, data) == set()
