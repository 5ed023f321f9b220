"""The same results as ``core_problems`` in DuckDB's SQL, over the same whole tables."""

from weir.operators.schema_fold import ALIKE_SHARE, CONTENT, CONTRACT, HINTS

_FIRSTS = """
firsts AS (
  SELECT * FROM (
    SELECT order_id, order_timestamp AS e, ingestion_timestamp AS a, currency, total_amount,
      row_number() OVER (PARTITION BY order_id ORDER BY ingestion_timestamp, order_timestamp, currency NULLS FIRST, total_amount NULLS FIRST) AS rn
    FROM silver_orders WHERE order_timestamp IS NOT NULL AND ingestion_timestamp IS NOT NULL
  ) WHERE rn = 1
)"""

_LOADS = """
loads AS (
  SELECT 'silver_orders' AS table_name, load_id, lag(load_id) OVER (PARTITION BY stream ORDER BY load_id) AS load_before
  FROM (SELECT DISTINCT source_file AS load_id, regexp_replace(source_file, '[^/]*$', '') AS stream FROM silver_orders WHERE trim(source_file) <> '')
  UNION ALL
  SELECT 'metrics', load_id, lag(load_id) OVER (PARTITION BY stream ORDER BY at_ts, load_id)
  FROM (SELECT run_id AS load_id, min(pipeline_name) AS stream, min(run_timestamp) AS at_ts FROM metrics WHERE trim(run_id) <> '' GROUP BY 1)
)"""

_CELLS = """
cells AS (
  SELECT 'silver_orders' AS table_name, source_file AS load_id, unnest(['customer_id', 'quantity', 'unit_price']) AS column_name,
    unnest([customer_id, CAST(quantity AS VARCHAR), CASE WHEN NOT isnan(unit_price) THEN CAST(unit_price AS VARCHAR) END]) AS v
  FROM silver_orders WHERE trim(source_file) <> ''
  UNION ALL
  SELECT 'metrics', run_id, unnest(['rule_name', 'dataset_name']), unnest([rule_name, dataset_name]) FROM metrics WHERE trim(run_id) <> ''
),
valued AS (SELECT table_name, load_id, column_name, CASE WHEN trim(v) <> '' THEN v END AS v FROM cells)"""

_MASK = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '[0-9]', '9', 'g'), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '[^\x00-\x7F]+', 'u', 'g'), '\s+', ' ', 'g')"


def _java(v: str) -> str:
    """A double as Java writes it: with an exponent from 1e7 on and below 1e-3."""
    t = f"CAST(abs({v}) AS VARCHAR)"
    digits = f"rtrim(ltrim(replace({t}, '.', ''), '0'), '0')"
    mantissa = f"left({digits}, 1) || '.' || CASE WHEN len({digits}) > 1 THEN substr({digits}, 2) ELSE '0' END"
    exponent = f"CASE WHEN abs({v}) >= 1 THEN len(split_part({t}, '.', 1)) - 1 ELSE -(len(split_part({t}, '.', 2)) - len(ltrim(split_part({t}, '.', 2), '0')) + 1) END"
    far = f"CASE WHEN contains({t}, 'e') THEN CASE WHEN contains({t}, '.') THEN split_part({t}, 'e', 1) ELSE split_part({t}, 'e', 1) || '.0' END || 'E' || CAST(CAST(split_part({t}, 'e', 2) AS INTEGER) AS VARCHAR) ELSE {mantissa} || 'E' || CAST({exponent} AS VARCHAR) END"
    return f"CASE WHEN isnan({v}) THEN NULL WHEN {v} <> 0 AND (abs({v}) >= 1e7 OR abs({v}) < 1e-3) THEN CASE WHEN {v} < 0 THEN '-' ELSE '' END || {far} ELSE CAST({v} AS VARCHAR) END"


# The columns of the profiled tables by kind.
_KINDS = {
    "silver_orders": {"text": "order_id customer_id product_id order_status currency", "whole": "quantity", "double": "unit_price total_amount", "time": "order_timestamp order_date ingestion_timestamp"},
    "metrics": {"text": "dataset_name layer rule_name rule_version metric_name severity pipeline_name metadata_json", "whole": "total_records failed_records", "double": "metric_value", "time": "run_timestamp", "flag": "passed"},
}
_LOAD = {"silver_orders": "source_file", "metrics": "run_id"}


def _all_cells() -> str:
    """(table_name, load_id, column_name, v, number) of every column; v is null for rows without value."""
    parts = []
    for table, kinds in _KINDS.items():
        for kind, names in kinds.items():
            for c in names.split():
                text = {"text": f"CASE WHEN trim({c}) <> '' THEN {c} END", "double": _java(c)}.get(kind, f"CAST({c} AS VARCHAR)")
                number = {"whole": f"CAST({c} AS DOUBLE)", "double": f"CASE WHEN NOT isnan({c}) THEN {c} END", "time": f"CAST(epoch_us(CAST({c} AS TIMESTAMP)) AS DOUBLE)"}.get(kind, "CAST(NULL AS DOUBLE)")
                parts.append(f"SELECT '{table}' AS table_name, {_LOAD[table]} AS load_id, '{c}' AS column_name, {text} AS v, {number} AS number FROM {table} WHERE trim({_LOAD[table]}) <> ''")
    return "valued AS (" + " UNION ALL ".join(parts) + ")"


def _shift(by: str) -> str:
    return f"""
counts AS (SELECT table_name, load_id, column_name, {by} AS v, count(*) AS n FROM valued WHERE v IS NOT NULL GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY table_name, load_id, column_name) AS share FROM counts),
moved AS (
  SELECT table_name, load_id, column_name, v, share, 0.0 AS before FROM shares
  UNION ALL
  SELECT s.table_name, l.load_id, s.column_name, s.v, 0.0, s.share FROM shares s JOIN loads l ON l.table_name = s.table_name AND l.load_before = s.load_id
),
divergence AS (
  SELECT table_name, load_id, column_name, sum(abs(share - before)) / 2 AS d
  FROM (SELECT table_name, load_id, column_name, v, sum(share) AS share, sum(before) AS before FROM moved GROUP BY ALL)
  GROUP BY ALL HAVING sum(share) > 0 AND sum(before) > 0
)"""


_ORPHANS = """
history AS (SELECT DISTINCT ref_table, key_value, change_kind, changed_at FROM key_history),
refs AS (
  SELECT order_id, CAST(order_timestamp AS DATE) AS order_day, ingestion_timestamp AS at_ts, 'customer_id' AS field_name, 'silver_customers' AS ref_table, upper(trim(customer_id)) AS k FROM silver_orders WHERE trim(customer_id) <> ''
  UNION ALL
  SELECT order_id, CAST(order_timestamp AS DATE), ingestion_timestamp, 'product_id', 'silver_products', upper(trim(product_id)) FROM silver_orders WHERE trim(product_id) <> ''
),
firsts AS (SELECT ref_table, key_value, min(changed_at) AS first_at FROM history GROUP BY 1, 2),
dated AS (
  SELECT r.*, f.first_at, h.change_kind FROM refs r
  LEFT JOIN firsts f ON f.ref_table = r.ref_table AND f.key_value = r.k
  ASOF LEFT JOIN history h ON h.ref_table = r.ref_table AND h.key_value = r.k AND h.changed_at <= r.at_ts
),
judged AS (SELECT *, CASE WHEN first_at IS NULL THEN 'missing' WHEN first_at > at_ts THEN 'late' WHEN change_kind = 'deleted' THEN 'deleted' END AS key_state FROM dated)"""

def _layouts() -> str:
    """The files of raw_order_files as cells, facts and resolved fields. Names that neither content nor
    wording tells, which the operator compares with the file before, stand for themselves."""
    seps = [",", ";", "|", "\t"]
    n = [f"(len(h) - len(replace(h, '{x}', '')))" for x in seps]
    sep = f"CASE WHEN {n[0]} >= greatest({n[1]}, {n[2]}, {n[3]}) THEN ',' WHEN {n[1]} >= greatest({n[2]}, {n[3]}) THEN ';' WHEN {n[2]} >= {n[3]} THEN '|' ELSE '\t' END"

    def split(line: str) -> str:
        def cells(x: str) -> str:
            of = "\\|" if x == "|" else x
            part = f"regexp_extract_all('{x}' || {line}, '{of}(\"(?:[^\"]|\"\")*\"|[^{of}]*)', 1)"
            return f"CASE WHEN contains({line}, '\"') THEN list_transform({part}, lambda c: CASE WHEN len(c) > 1 AND starts_with(c, '\"') AND ends_with(c, '\"') THEN replace(c[2:-2], '\"\"', '\"') ELSE c END) ELSE string_split({line}, '{x}') END"

        return "CASE sep " + " ".join(f"WHEN '{x}' THEN {cells(x)}" for x in seps) + " END"

    like = {f: f"regexp_full_match(v, '(?i)({p})')" for f, p in CONTENT.items()}
    own = ", ".join(f"'{f}'" for f in CONTRACT)
    majority = {f: f"like_{f} > {ALIKE_SHARE} * value_count" for f in CONTENT}
    anywhere = {f: f"all_{f} > {ALIKE_SHARE} * all_count" for f in CONTENT}
    q, u = (f"regexp_matches(name, '{HINTS[f]}')" for f in ("quantity", "unit_price"))
    told = " ".join(f"WHEN (({majority[f]}) OR (value_count = 0 AND {anywhere[f]})) AND NOT with_{f} THEN '{f}'" for f in CONTRACT if f not in HINTS)
    weak = {f: f"(value_count = 0 OR greatest(numbers, like_{f}) > {ALIKE_SHARE} * value_count) AND NOT with_{f}" for f in HINTS}
    return f"""
lines AS (SELECT file_id, coalesce(feed, '') AS feed, file_seq, lower(trim(fmt)) AS fmt, line_no, min(raw_line) AS raw_line FROM raw_order_files WHERE file_id IS NOT NULL AND trim(raw_line) <> '' GROUP BY ALL),
files AS (SELECT file_id, min(feed) AS feed, min(file_seq) AS file_seq FROM lines GROUP BY 1),
turns AS (SELECT *, lag(file_id) OVER w AS last_file, row_number() OVER w = 1 AS is_first FROM files WINDOW w AS (PARTITION BY feed ORDER BY file_seq, file_id)),
headers AS (SELECT file_id, h, {sep} AS sep FROM (SELECT file_id, raw_line AS h FROM lines WHERE fmt = 'csv' AND line_no = 1)),
titled AS (SELECT file_id, sep, list_transform({split("h")}, lambda c: lower(trim(c))) AS names FROM headers),
delimited AS (SELECT l.file_id, l.line_no, l.line_no = 1 AS header, t.names, {split("l.raw_line")} AS tokens FROM lines l JOIN titled t USING (file_id) WHERE l.fmt = 'csv'),
csv_cells AS (SELECT file_id, line_no, names[i] AS name, CASE WHEN NOT header AND trim(tokens[i]) <> '' THEN tokens[i] END AS raw, NULL AS kind FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM delimited)),
objects AS (SELECT file_id, line_no, CAST(raw_line AS JSON) AS j FROM lines WHERE fmt = 'json' AND json_valid(raw_line) AND json_type(raw_line) = 'OBJECT'),
pairs AS (SELECT file_id, line_no, k, json_extract(j, '$."' || k || '"') AS e FROM (SELECT *, unnest(json_keys(j)) AS k FROM objects)),
json_cells AS (
  SELECT file_id, line_no, lower(trim(k)) AS name, CASE WHEN json_type(e) = 'DOUBLE' THEN regexp_replace(e ->> '$', '[.]0+$', '') ELSE e ->> '$' END AS raw,
    CASE json_type(e) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN NULL ELSE 'string' END AS kind
  FROM pairs
),
cells AS (SELECT *, trim(raw) AS v FROM (SELECT * FROM csv_cells UNION ALL SELECT * FROM json_cells) WHERE name <> ''),
classed AS (
  SELECT *, CASE WHEN v IS NULL THEN NULL WHEN kind IS NOT NULL THEN kind WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'integer' WHEN regexp_full_match(v, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'decimal'
    WHEN lower(v) IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS class FROM cells
),
facts AS (
  SELECT file_id, name, CASE WHEN count(class) = 0 THEN NULL WHEN count(DISTINCT class) = 1 THEN min(class) WHEN bool_and(class IN ('integer', 'decimal')) THEN 'decimal' ELSE 'string' END AS class, count(v) AS value_count,
    count(TRY_CAST(v AS DOUBLE)) AS numbers, {", ".join(f"count(*) FILTER ({x}) AS like_{f}" for f, x in like.items())}
  FROM classed GROUP BY ALL
),
held AS (SELECT t.feed, f.*, list(f.name) OVER (PARTITION BY f.file_id) AS beside FROM facts f JOIN turns t USING (file_id)),
here AS (
  SELECT feed, name, sum(value_count) AS value_count, sum(numbers) AS numbers, {", ".join(f"sum(like_{f}) AS like_{f}, bool_or(list_contains(beside, '{f}')) AS with_{f}" for f in CONTRACT)}
  FROM held WHERE name NOT IN ({own}) GROUP BY ALL
),
anywhere AS (SELECT name, sum(value_count) AS all_count, {", ".join(f"sum(like_{f}) AS all_{f}" for f in CONTRACT)} FROM here GROUP BY 1),
spoken AS (SELECT feed, name, CASE {told} WHEN {q} AND {weak["quantity"]} THEN 'quantity' WHEN {u} AND NOT {q} AND {weak["unit_price"]} THEN 'unit_price' ELSE name END AS field FROM here JOIN anywhere USING (name)),
resolved AS (SELECT h.feed, h.file_id, h.name, coalesce(s.field, h.name) AS field, h.class FROM held h LEFT JOIN spoken s ON s.feed = h.feed AND s.name = h.name)"""


def _join_class(c: str) -> str:
    return f"CASE WHEN count({c}) = 0 THEN NULL WHEN count(DISTINCT {c}) = 1 THEN min({c}) WHEN bool_and({c} IN ('integer', 'decimal')) THEN 'decimal' ELSE 'string' END"


ORACLES = {
    "p5_found": f"""WITH {_layouts()},
own AS (SELECT file_id, field, min(name) AS name, {_join_class("class")} AS class FROM resolved GROUP BY 1, 2),
start AS (SELECT feed, unnest([{", ".join(f"'{f}'" for f in CONTRACT)}]) AS field, unnest([{", ".join(f"'{c}'" for c in CONTRACT.values())}]) AS class FROM (SELECT DISTINCT feed FROM turns)),
chain AS (
  SELECT feed, -1 AS file_seq, CAST(NULL AS BIGINT) AS file_id, field, field AS name, class FROM start
  UNION ALL SELECT t.feed, t.file_seq, t.file_id, o.field, o.name, o.class FROM own o JOIN turns t USING (file_id)
),
kept AS (SELECT * EXCLUDE (class), last_value(class IGNORE NULLS) OVER (PARTITION BY feed, field ORDER BY file_seq, file_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS class FROM chain),
sides AS (
  SELECT t.file_id, coalesce(n.field, b.field) AS field, n.name AS now_name, n.class AS now_class, b.name AS was_name, b.class AS was_class
  FROM turns t JOIN (SELECT DISTINCT feed, field FROM kept) f ON f.feed = t.feed
  LEFT JOIN kept n ON n.file_id = t.file_id AND n.field = f.field
  LEFT JOIN kept b ON b.feed = t.feed AND b.field = f.field AND (CASE WHEN t.is_first THEN b.file_id IS NULL ELSE b.file_id = t.last_file END)
)
SELECT file_id, field AS field_name, 'added' AS change_kind FROM sides WHERE now_name IS NOT NULL AND was_name IS NULL
UNION ALL SELECT file_id, field, 'removed' FROM sides WHERE now_name IS NULL AND was_name IS NOT NULL
UNION ALL SELECT file_id, field, 'renamed' FROM sides WHERE now_name <> was_name
UNION ALL SELECT file_id, field, 'retyped' FROM sides WHERE now_class <> was_class""",
    "p5_values": f"""WITH {_layouts()},
kinds AS (SELECT field, coalesce({_join_class("class")}, 'string') AS class FROM resolved GROUP BY 1),
placed AS (SELECT c.file_id, c.line_no, r.field, arg_min(c.raw, c.name) AS raw FROM cells c JOIN resolved r ON r.file_id = c.file_id AND r.name = c.name WHERE c.v IS NOT NULL GROUP BY ALL)
SELECT file_id, line_no, field AS field_name, CASE class WHEN 'integer' THEN CAST(TRY_CAST(trim(raw) AS BIGINT) AS VARCHAR) WHEN 'decimal' THEN CAST(TRY_CAST(trim(raw) AS DECIMAL(38, 10)) AS VARCHAR) WHEN 'boolean' THEN lower(trim(raw)) ELSE raw END AS value
FROM placed JOIN kinds USING (field)""",
    "p2_profile": f"""WITH {_all_cells()},
vals AS (SELECT table_name, load_id, column_name, v, {_MASK} AS mask, count(*) AS n, min(number) AS low, max(number) AS high FROM valued GROUP BY ALL),
masks AS (
  SELECT table_name, load_id, column_name, mask, sum(n) AS n, count(v) AS d, min(low) AS low, max(high) AS high, min(len(v)) AS short, max(len(v)) AS long, min(v) FILTER (low IS NULL) AS first, max(v) FILTER (low IS NULL) AS last
  FROM vals GROUP BY ALL
)
SELECT table_name, load_id, column_name, CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER (mask IS NULL), 0) AS BIGINT) AS null_count, CAST(sum(d) AS BIGINT) AS distinct_values,
  min(low) AS min_number, max(high) AS max_number, CAST(min(short) AS INTEGER) AS min_length, CAST(max(long) AS INTEGER) AS max_length, min(first) AS min_text, max(last) AS max_text, count(mask) AS mask_count,
  arg_max(mask, (n, mask)) FILTER (mask IS NOT NULL) AS dominant_mask, CAST(max(n) FILTER (mask IS NOT NULL) AS BIGINT) AS dominant_count
FROM masks GROUP BY ALL""",
    "p2_mask_shift": f"""WITH {_LOADS}, {_all_cells()}, {_shift(_MASK)} SELECT table_name, column_name, load_id, round(d, 9) AS divergence FROM divergence""",
    "p2_rare_masks_all": f"""WITH {_all_cells()}, masks AS (SELECT table_name, column_name, load_id, {_MASK} AS mask, count(*) AS n FROM valued WHERE v IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY table_name, column_name, load_id) AS BIGINT) AS value_count FROM masks) WHERE n / value_count < 0.05""",
    "p1_found": f"""WITH {_FIRSTS}
SELECT order_id, strftime(e, '%Y-%m-%d') AS order_day, CASE WHEN a - e > INTERVAL 72 HOURS THEN 'cut_off' ELSE 'corrects' END AS outcome
FROM firsts WHERE CAST(a AS DATE) > CAST(e AS DATE)""",
    "p1_revenue": f"""WITH {_FIRSTS},
taken AS (
  SELECT CAST(e AS DATE) AS order_date, currency, CAST(a AS DATE) AS published_day,
    sum(CASE WHEN NOT isnan(total_amount) THEN CAST(total_amount AS DECIMAL(38, 2)) END) AS amount, count(*) AS n
  FROM firsts WHERE NOT (a - e > INTERVAL 72 HOURS) GROUP BY ALL
)
SELECT order_date, currency, published_day, CAST(coalesce(sum(amount) OVER w, 0) AS DOUBLE) AS total_revenue, CAST(sum(n) OVER w AS BIGINT) AS order_count,
  CAST(row_number() OVER w - 1 AS INTEGER) AS revision
FROM taken WINDOW w AS (PARTITION BY order_date, currency ORDER BY published_day)""",
    "p2_found": f"""WITH {_LOADS}, {_CELLS}, {_shift("v")},
stats AS (
  SELECT c.table_name, c.load_id, c.column_name, count(*) AS n, count(v) AS valued, count(DISTINCT v) AS distinct_values,
    count(*) FILTER (WHERE NOT regexp_full_match(v, s.value_pattern)) AS off,
    count(*) FILTER (WHERE CASE WHEN c.column_name IN ('quantity', 'unit_price') THEN TRY_CAST(v AS DOUBLE) < s.min_value OR TRY_CAST(v AS DOUBLE) > s.max_value END) AS beyond
  FROM valued c LEFT JOIN column_specs s USING (table_name, column_name) GROUP BY ALL
),
paired AS (
  SELECT s.*, b.distinct_values AS distinct_before, d.d FROM stats s JOIN loads l USING (table_name, load_id)
  LEFT JOIN stats b ON b.table_name = s.table_name AND b.column_name = s.column_name AND b.load_id = l.load_before
  LEFT JOIN divergence d ON d.table_name = s.table_name AND d.column_name = s.column_name AND d.load_id = s.load_id
)
SELECT table_name, column_name, load_id, 'nulls' AS issue FROM paired WHERE (n - valued) / n > 0.2
UNION ALL SELECT table_name, column_name, load_id, 'pattern' FROM paired WHERE off / nullif(valued, 0) > 0.05
UNION ALL SELECT table_name, column_name, load_id, 'range' FROM paired WHERE beyond / nullif(valued, 0) > 0.05
UNION ALL SELECT table_name, column_name, load_id, 'distinct' FROM paired WHERE column_name IN ('customer_id', 'rule_name', 'dataset_name')
  AND valued > 0 AND distinct_before > 0 AND (distinct_values * 2 < distinct_before OR distinct_values > 2 * distinct_before)
UNION ALL SELECT table_name, column_name, load_id, 'shift' FROM paired WHERE column_name IN ('rule_name', 'dataset_name') AND d > 0.5""",
    "p2_rare_masks": f"""WITH {_CELLS}, masks AS (SELECT table_name, column_name, load_id, {_MASK} AS mask, count(*) AS n FROM valued WHERE v IS NOT NULL AND column_name NOT IN ('quantity', 'unit_price') GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY table_name, column_name, load_id) AS BIGINT) AS value_count FROM masks) WHERE n / value_count < 0.05""",
    "p4_found": f"WITH {_ORPHANS} SELECT DISTINCT order_id, field_name, key_state FROM judged WHERE key_state IS NOT NULL",
    "p4_ledger": f"""WITH {_ORPHANS}, state AS (SELECT ref_table, key_value, arg_max(change_kind, changed_at) AS last FROM history GROUP BY 1, 2)
SELECT r.ref_table, r.k AS ref_key, count(*) AS refs, CASE WHEN s.last IS NULL THEN 'missing' ELSE 'deleted' END AS key_state
FROM refs r LEFT JOIN state s ON s.ref_table = r.ref_table AND s.key_value = r.k WHERE r.at_ts IS NOT NULL AND (s.last IS NULL OR s.last = 'deleted') GROUP BY ALL""",
    "p4_daily": f"WITH {_ORPHANS} SELECT ref_table, order_day, key_state, count(*) AS reference_count FROM judged WHERE key_state IS NOT NULL GROUP BY ALL",
}
