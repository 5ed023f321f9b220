"""Plain Python versions of operators that SQL cannot express."""

from __future__ import annotations

import csv
import io
import json
import re
from collections import defaultdict

FIELDS = {"order_id": "string", "customer_id": "string", "product_id": "string", "order_status": "string", "quantity": "integer", "unit_price": "decimal", "currency": "string", "order_timestamp": "string"}
ALIASES = {
    "qty": "quantity", "amount_of_items": "quantity", "units": "quantity", "order_qty": "quantity",
    "ccy": "currency", "cur": "currency", "curr_code": "currency", "money_unit": "currency",
    "price": "unit_price", "price_each": "unit_price", "cust": "customer_id", "client_no": "customer_id",
    "item_code": "product_id", "state": "order_status",
}


def _text_class(text: str) -> str:
    text = text.strip()
    if re.fullmatch(r"[+-]?\d+", text):
        return "integer"
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)", text):
        return "decimal"
    return "boolean" if text.lower() in ("true", "false") else "string"


def layout_changes(rows: list[tuple]) -> set[tuple]:
    """rows: (file_id, feed, file_seq, fmt, line_no, raw_line) -> {(file_id, field_name, change_kind)}."""
    files: dict = defaultdict(dict)
    for file_id, feed, seq, fmt, line_no, line in rows:
        files[feed, seq, file_id, fmt][line_no] = line
    feeds: dict = defaultdict(list)
    for (feed, seq, file_id, fmt), lines in sorted(files.items()):
        classes: dict = defaultdict(set)
        if fmt == "csv":
            sep = max(",;|", key=lines[1].count)
            names = [n.strip().lower() for n in next(csv.reader(io.StringIO(lines[1]), delimiter=sep))]
            for n in names:
                classes[n]
            for no, line in lines.items():
                if no != 1:
                    for n, v in zip(names, next(csv.reader(io.StringIO(line), delimiter=sep)), strict=False):
                        if v.strip():
                            classes[n].add(_text_class(v))
        else:
            for line in lines.values():
                for n, v in json.loads(line).items():
                    n = n.strip().lower()
                    classes[n]
                    if v is not None:
                        classes[n].add("boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "decimal" if isinstance(v, float) else "string")
        layout = {}
        for n, c in classes.items():
            kind = None if not c else next(iter(c)) if len(c) == 1 else "decimal" if c == {"integer", "decimal"} else "string"
            layout[ALIASES.get(n, n)] = [n, kind]
        feeds[feed].append((file_id, layout))
    found = set()
    for chain in feeds.values():
        before = {f: [f, c] for f, c in FIELDS.items()}
        last = dict(FIELDS)
        for file_id, layout in chain:
            for f, x in layout.items():
                x[1] = x[1] or last.get(f)
                if f not in before:
                    found.add((file_id, f, "added"))
                else:
                    if before[f][0] != x[0]:
                        found.add((file_id, f, "renamed"))
                    if x[1] and before[f][1] and before[f][1] != x[1]:
                        found.add((file_id, f, "retyped"))
                if x[1]:
                    last[f] = x[1]
            found |= {(file_id, f, "removed") for f in before if f not in layout}
            before = layout
    return found
