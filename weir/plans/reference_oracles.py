"""The same results as ``reference_queries`` in DuckDB's SQL."""

from itertools import accumulate

from weir.schemas import CONTRACT_NAMES, CURRENCIES, STATUSES
from weir.sources import synth


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v.lower()}'" for v in values)


_MONEY = "CASE WHEN NOT isnan({c}) THEN TRY_CAST({c} AS DECIMAL(28, 8)) END"
_AMOUNT, _PRICE = _MONEY.format(c="total_amount"), _MONEY.format(c="unit_price")
_SUM = f"coalesce(CAST(sum({_AMOUNT}) AS DOUBLE), 0)"
_MEAN = f"CAST(sum({_AMOUNT}) AS DOUBLE) / nullif(count({_AMOUNT}), 0)"
_LATEST = "row_number() OVER (PARTITION BY order_id ORDER BY order_timestamp DESC NULLS LAST, {rest})"
_ALL = "order_id, customer_id, product_id, order_status, quantity, unit_price, total_amount, currency, order_timestamp, order_date, ingestion_timestamp, source_file"
_NULLS_LAST = ", ".join(f"{c.strip()} NULLS LAST" for c in _ALL.split(","))
_RAW = "SELECT order_id, customer_id, product_id, order_status, quantity, unit_price, currency, date_trunc('second', order_timestamp) AS order_timestamp FROM silver_orders"
_RAW_LAST = ", ".join(f"{c} NULLS LAST" for c in ("order_id", "customer_id", "product_id", "order_status", "quantity", "unit_price", "currency", "order_timestamp"))
_DUPES = "SELECT count(*) AS n, count(*) FILTER (c > 1) AS g, sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS r, sum(c - 1) AS x, sum(c) AS t FROM (SELECT count(*) AS c FROM silver_orders GROUP BY order_id)"
_BAD_STATUS = f"order_status IS NOT NULL AND lower(order_status) NOT IN ({_list(STATUSES)})"
_BAD_CURRENCY = f"currency IS NOT NULL AND lower(currency) NOT IN ({_list(CURRENCIES)})"
_BAD_PRICE = "coalesce(unit_price <= 0 OR isnan(unit_price), false)"


def _rules_bronze() -> str:
    counts = {
        "bronze_order_id_not_null": ("count(*) FILTER (order_id IS NULL)", "critical"),
        "bronze_customer_id_not_null": ("count(*) FILTER (customer_id IS NULL)", "warning"),
        "bronze_order_id_unique": (f"(SELECT x FROM ({_DUPES}))", "warning"),
        "bronze_order_status_valid": (f"count(*) FILTER ({_BAD_STATUS})", "warning"),
        "bronze_currency_valid": (f"count(*) FILTER ({_BAD_CURRENCY})", "warning"),
        "bronze_quantity_positive": ("count(*) FILTER (quantity <= 0)", "warning"),
        "bronze_unit_price_positive": (f"count(*) FILTER ({_BAD_PRICE})", "warning"),
        "bronze_schema_drift": ("0", "critical"),
    }
    each = [f"SELECT '{r}' AS rule_id, count(*) AS total_records, CAST({e} AS BIGINT) AS failed_records, {e} = 0 AS passed, '{s}' AS severity FROM silver_orders" for r, (e, s) in counts.items()]
    return " UNION ALL ".join(each)


def _marks(conditions: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in conditions.items()) + ")"


_ROW_RULES = {
    "bronze_order_id_not_null": "order_id IS NULL",
    "bronze_customer_id_not_null": "customer_id IS NULL",
    "bronze_order_status_valid": _BAD_STATUS,
    "bronze_currency_valid": _BAD_CURRENCY,
    "bronze_quantity_positive": "quantity <= 0",
    "bronze_unit_price_positive": _BAD_PRICE,
}
_STRICT = {"silver_currency_valid": _BAD_CURRENCY, "silver_order_status_valid": _BAD_STATUS, "silver_quantity_positive": "quantity <= 0", "silver_unit_price_positive": _BAD_PRICE}
_REJECTED = {"customer_id_null": "customer_id IS NULL", "product_id_null": "product_id IS NULL", "order_timestamp_unreadable": "order_timestamp IS NULL"}
_QUANTITY = "SELECT avg(quantity) AS m, stddev(quantity) AS s, quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.5) AS q2, quantile_cont(quantity, 0.75) AS q3 FROM silver_orders WHERE order_date {side} DATE '2024-11-01'"


def _drift(q: str) -> str:
    return f"CASE WHEN b.{q} = 0 THEN CASE WHEN a.{q} = 0 THEN 0.0 ELSE 100.0 END ELSE round((a.{q} - b.{q}) / abs(b.{q}) * 100, 2) END"


_SILVER = f"""silver AS (
  SELECT *, CAST(order_timestamp AS DATE) AS order_date, round(quantity * unit_price, 2) AS total_amount
  FROM (SELECT *, {_LATEST.format(rest=_RAW_LAST)} AS rn FROM ({_RAW}) WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND product_id IS NOT NULL AND order_timestamp IS NOT NULL) WHERE rn = 1
)"""
_BANDS = "greatest(" + ", ".join(f"abs((SELECT (n.q - o.q) / abs(o.q) * 100 FROM (SELECT quantile_cont(total_revenue, {p}) AS q FROM gold_daily_revenue) n, (SELECT quantile_cont(total_revenue, {p}) AS q FROM gold_daily_revenue WHERE order_date < DATE '2024-11-01') o))" for p in (0.25, 0.5, 0.75)) + ")"


def _metrics_long() -> str:
    """The metrics of the stock Silver set; of distributions those that are exact."""
    rate = "failed / n"
    parts = [
        ("silver_customer_id_not_null", "critical", "count(*) FILTER (customer_id IS NULL)", {"null_rate": rate}),
        ("silver_order_id_unique", "critical", f"(SELECT x FROM ({_DUPES}))", {"duplicate_groups": f"(SELECT g FROM ({_DUPES}))"}),
        ("silver_freshness_check", "warning", "CASE WHEN max(ingestion_timestamp) < TIMESTAMP '2024-12-15 20:00:00' THEN count(*) ELSE 0 END", {"freshness_lag_hours": "round(age, 2)"}),
        ("silver_dedup_orders", "critical", f"(SELECT x FROM ({_DUPES}))", {"dedup_ratio": "round((n - failed) / n, 4)"}),
    ]
    out = []
    for rule, severity, failed, more in parts:
        metrics = {"failure_rate": rate, "pass_rate": f"100.0::DOUBLE * (1 - {rate})", **more}
        base = f"(SELECT count(*) AS n, CAST({failed} AS BIGINT) AS failed, date_diff('microsecond', max(ingestion_timestamp), TIMESTAMP '2024-12-16') / 3.6e9 AS age FROM silver_orders)"
        out += [f"SELECT '{rule}' AS rule_name, '{m}' AS metric_name, round({e}, 6) AS metric_value, failed = 0 AS passed, '{severity}' AS severity, n AS total_records, failed AS failed_records FROM {base}" for m, e in metrics.items()]
    for rule, c in (("silver_price_distribution", "unit_price"), ("silver_quantity_distribution", "quantity")):
        v = f"CAST({c} AS DOUBLE)"
        plain = f"{v} IS NOT NULL AND NOT isnan({v})"
        metrics = {"failure_rate": "0.0::DOUBLE", "pass_rate": "100.0::DOUBLE", f"stat_count:{c}": f"count(*) FILTER ({plain})", f"stat_min:{c}": f"min({v}) FILTER ({plain})", f"stat_max:{c}": f"max({v}) FILTER ({plain})", f"stat_nan_count:{c}": f"count(*) FILTER (isnan({v}))"}
        out += [f"SELECT '{rule}', '{m}', round(CAST({e} AS DOUBLE), 6), true, 'warning', count(*), 0 FROM silver_orders" for m, e in metrics.items()]
    return "SELECT 'run-1' AS run_id, 'silver_orders' AS dataset_name, 'silver' AS layer, '1.0' AS rule_version, '2024-12-16 00:00:00' AS run_timestamp, 'orders' AS pipeline_name, * FROM (" + " UNION ALL ".join(out) + ")"


def _draw(salt: str, key: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 7) AS BIGINT) / {float(1 << 28)})"


def _choose(u: str, shares: dict) -> str:
    steps = list(zip(shares, (s / sum(shares.values()) for s in accumulate(shares.values())), strict=True))
    return "CASE " + " ".join(f"WHEN {u} < {s!r} THEN '{v}'" for v, s in steps[:-1]) + f" ELSE '{steps[-1][0]}' END"


def _list_price(p: str) -> str:
    return f"round(9.99::DOUBLE + ({p} - 1) * {390.0 / (synth.PRODUCTS - 1)!r}::DOUBLE, 2)"


def _events() -> str:
    """The generated events again, from the same draws."""
    u = {s: _draw(f"42:{s}", "i") for s in ("product", "customer", "status", "size", "many", "price", "currency", "time")}
    return f"""drawn AS (SELECT i, CAST(floor(pow({u["product"]}, 2.0) * {synth.PRODUCTS}) AS INTEGER) + 1 AS p FROM range(10000) t(i)),
events_made AS (
  SELECT printf('ORD-%08d', i) AS order_id, printf('CUST-%04d', CAST(floor(pow({u["customer"]}, 3.0) * {synth.CUSTOMERS}) AS INTEGER) + 1) AS customer_id, printf('PROD-%03d', p) AS product_id, {_choose(u["status"], synth.STATUS_SHARES)} AS order_status,
    CASE WHEN {u["size"]} < 0.6 THEN 1 WHEN {u["size"]} < 0.85 THEN 2 WHEN {u["size"]} < 0.95 THEN 3 ELSE 4 + CAST(floor({u["many"]} * 7) AS INTEGER) END AS quantity, round({_list_price("p")} * (0.9::DOUBLE + 0.2::DOUBLE * {u["price"]}), 2) AS unit_price,
    {_choose(u["currency"], synth.CURRENCY_SHARES)} AS currency, strftime(TIMESTAMP '2024-01-01' + to_seconds(CAST(floor({u["time"]} * date_diff('second', TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31 23:59:59')) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS order_timestamp
  FROM drawn
)"""


def _faults() -> str:
    f = synth.Faults()

    def hit(salt: str, rate: float) -> str:
        return f"{_draw(f'42:{salt}', 'order_id')} < {rate}"

    def pick(salt: str, values: tuple) -> str:
        return f"[{', '.join(repr(v) for v in values)}][CAST(floor({_draw(f'42:{salt}', 'order_id')} * {len(values)}) AS INTEGER) + 1]"

    return f"""faulty AS (
  SELECT order_id, CASE WHEN NOT {hit("nc", f.null_customer)} THEN customer_id END AS customer_id, CASE WHEN {hit("up", f.unknown_product)} THEN printf('INVALID-%03d', CAST(floor({_draw("42:upv", "order_id")} * 999) AS INTEGER) + 1) ELSE product_id END AS product_id,
    CASE WHEN {hit("bs", f.bad_status)} THEN {pick("bsv", synth.BAD_STATUSES)} ELSE order_status END AS order_status, CASE WHEN {hit("nq", f.negative_quantity)} THEN -(CAST(floor({_draw("42:nqv", "order_id")} * 5) AS INTEGER) + 1) ELSE quantity END AS quantity, unit_price,
    CASE WHEN {hit("bc", f.bad_currency)} THEN {pick("bcv", synth.BAD_CURRENCIES)} ELSE currency END AS currency, CASE WHEN {hit("bt", f.bad_time)} THEN {_choose(_draw("42:btv", "order_id"), synth.BAD_TIMES)} ELSE order_timestamp END AS order_timestamp,
    {pick("lt", synth.TIERS)} AS loyalty_tier
  FROM events_made
),
copies AS (SELECT * REPLACE (CASE WHEN len(order_timestamp) = 19 THEN left(order_timestamp, 17) || lpad(CAST(CAST(floor({_draw("42:nds", "order_id")} * 60) AS INTEGER) AS VARCHAR), 2, '0') ELSE order_timestamp END AS order_timestamp) FROM faulty WHERE {hit("nd", f.duplicate)})"""


ORACLES = {
    "rule_not_null": "SELECT count(*) AS total_records, count(*) - count(customer_id) AS failed_records, (count(*) - count(customer_id)) / count(*) AS failure_rate, count(*) = count(customer_id) AS passed FROM silver_orders",
    "rule_unique_key": f"SELECT CAST(t AS BIGINT) AS total_records, g AS duplicate_groups, CAST(r AS BIGINT) AS duplicate_records, CAST(x AS BIGINT) AS excess_records FROM ({_DUPES})",
    "rule_unique_key_failures": "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "rule_accepted_values": f"SELECT currency, count(*) AS violation_count FROM silver_orders WHERE {_BAD_CURRENCY} GROUP BY 1",
    "rule_positive_numeric": f"SELECT count(*) AS total_records, count(*) FILTER ({_BAD_PRICE}) AS failed_records, count(*) FILTER (isnan(unit_price)) AS nan_count, min(unit_price) FILTER (unit_price <= 0) AS min_failing_value, max(unit_price) FILTER (unit_price <= 0) AS max_failing_value, round(avg(unit_price) FILTER (unit_price <= 0), 6) AS avg_failing_value FROM silver_orders",
    "rule_freshness": "SELECT round(h, 2) AS age_hours, round(greatest(0, h - 4), 2) AS breach_hours, h <= 4 AS passed FROM (SELECT date_diff('microsecond', max(ingestion_timestamp), TIMESTAMP '2024-12-16') / 3.6e9 AS h FROM silver_orders)",
    "rule_duplicates": f"SELECT CAST(t AS BIGINT) AS total_records, CAST(x AS BIGINT) AS surplus_records, round((t - x) / t, 4) AS dedup_ratio FROM ({_DUPES})",
    "op_surplus": f"SELECT {_ALL} FROM (SELECT *, {_LATEST.format(rest=_NULLS_LAST)} AS rn FROM silver_orders) WHERE rn > 1",
    "op_deduplicate": f"SELECT {_ALL} FROM (SELECT *, {_LATEST.format(rest=_NULLS_LAST)} AS rn FROM silver_orders) WHERE rn = 1",
    "rule_schema_drift": "SELECT * FROM (VALUES ('added', 'ingestion_timestamp'), ('added', 'order_date'), ('added', 'source_file'), ('added', 'total_amount'), ('retyped', 'order_timestamp')) v(change, column_name)",
    "rule_referential_integrity": "SELECT customer_id, count(*) AS orphan_count FROM silver_orders o WHERE customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM silver_customers c WHERE c.customer_id = o.customer_id) GROUP BY 1",
    "rule_row_count_anomaly": """WITH runs AS (SELECT run_id, max(run_timestamp) AS t, max(total_records) AS n FROM metrics WHERE dataset_name = 'silver_orders' AND run_id IS NOT NULL AND total_records > 0 GROUP BY 1 ORDER BY t DESC, run_id LIMIT 10),
base AS (SELECT avg(n) AS m, stddev_pop(n) AS s, min(n) AS lo, max(n) AS hi, count(*) AS k FROM runs), now AS (SELECT count(*) AS c FROM silver_orders)
SELECT c AS current_count, lo AS baseline_min, hi AS baseline_max, round(m, 1) AS baseline_mean, round(s, 1) AS baseline_stddev, round((c - m) / m * 100, 2) AS deviation_pct, CAST(k AS INTEGER) AS lookback_runs, CASE WHEN (c - m) / m * 100 < -30 THEN 'count_drop' WHEN (c - m) / m * 100 > 50 THEN 'count_spike' END AS anomaly_type FROM base, now""",
    "rule_distribution_stats": """WITH m AS (SELECT avg(l_extendedprice) AS a FROM lineitem),
p AS (SELECT avg((l_extendedprice - a) ** 2) AS m2, avg((l_extendedprice - a) ** 3) AS m3, avg((l_extendedprice - a) ** 4) AS m4 FROM lineitem, m)
SELECT count(*) AS value_count, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.75) AS p75,
  round(avg(l_extendedprice), 4) AS mean, round(stddev(l_extendedprice), 4) AS stddev, round(any_value(m3 / m2 ** 1.5), 6) AS skewness, round(any_value(m4 / m2 ** 2 - 3), 6) AS kurtosis FROM lineitem, p""",
    "rule_distribution_drift": f"""SELECT round((a.m - b.m) / b.s, 4) AS z_score, {_drift("q1")} AS drift_p25, {_drift("q2")} AS drift_p50, {_drift("q3")} AS drift_p75,
  abs((a.m - b.m) / b.s) > 3 OR greatest(abs({_drift("q1")}), abs({_drift("q2")}), abs({_drift("q3")})) > 20 AS is_anomaly
FROM ({_QUANTITY.format(side=">=")}) a, ({_QUANTITY.format(side="<")}) b""",
    "rules_bronze": _rules_bronze(),
    "violations_per_row": f"SELECT order_id, violated_rules FROM (SELECT order_id, {_marks(_ROW_RULES)} AS violated_rules FROM silver_orders) WHERE violated_rules <> ''",
    "contract_quality": f"""SELECT 'not_null:' || c AS check_name, round(v / n, 4) AS actual, CAST(1.0 AS DOUBLE) AS bound, v = n AS passed
FROM (SELECT unnest(['order_id', 'customer_id', 'product_id']) AS c, unnest([count(order_id), count(customer_id), count(product_id)]) AS v, count(*) AS n FROM silver_orders)
UNION ALL SELECT 'duplicate_rate', round(g / t, 4), 0, g = 0 FROM ({_DUPES}) UNION ALL SELECT 'row_count', CAST(t AS DOUBLE), 50, t >= 50 FROM ({_DUPES})""",
    "contract_schema": "SELECT * FROM (VALUES " + ", ".join(f"('missing', '{c}')" for c in ("avg_order_value", "computed_at", "order_count", "total_revenue", "unique_customers", "unique_products")) + ", " + ", ".join(f"('extra', '{c}')" for c in ("customer_id", "ingestion_timestamp", "order_id", "order_status", "order_timestamp", "product_id", "quantity", "source_file", "total_amount", "unit_price")) + ") v(finding, column_name)",
    "bronze_projection": "SELECT order_id, customer_id, product_id, order_status, quantity, unit_price, currency, order_timestamp, '2024-12-16 00:00:00' AS _ingestion_timestamp, 'run-1' AS _run_id FROM silver_orders",
    "silver_orders": f"WITH {_SILVER} SELECT order_id, customer_id, product_id, order_status, quantity, unit_price, total_amount, currency, strftime(order_timestamp, '%Y-%m-%d %H:%M:%S') AS order_timestamp, order_date, '2024-12-16 00:00:00' AS ingestion_timestamp, 'bronze_raw_events' AS source_file FROM silver",
    "pipeline_gold_daily": f"WITH {_SILVER} SELECT order_date, currency, {_SUM} AS total_revenue, count(*) AS order_count, {_MEAN} AS avg_order_value, count(DISTINCT customer_id) AS unique_customers, count(DISTINCT product_id) AS unique_products FROM silver GROUP BY 1, 2",
    "rules_silver": f"""WITH r(rule_id, failed, severity) AS (
  SELECT 'silver_customer_id_not_null', count(*) FILTER (customer_id IS NULL), 'critical' FROM silver_orders
  UNION ALL SELECT 'silver_order_id_unique', x, 'critical' FROM ({_DUPES}) UNION ALL SELECT 'silver_dedup_orders', x, 'critical' FROM ({_DUPES})
  UNION ALL SELECT 'silver_freshness_check', CASE WHEN max(ingestion_timestamp) < TIMESTAMP '2024-12-15 20:00:00' THEN count(*) ELSE 0 END, 'warning' FROM silver_orders
  UNION ALL SELECT 'silver_price_distribution', 0, 'warning' UNION ALL SELECT 'silver_quantity_distribution', 0, 'warning'
)
SELECT rule_id, (SELECT count(*) FROM silver_orders) AS total_records, CAST(failed AS BIGINT) AS failed_records, failed = 0 AS passed, severity FROM r""",
    "rules_gold": f"""WITH n AS (SELECT count(*) AS n FROM gold_daily_revenue), o AS (SELECT avg(total_revenue) AS m, stddev(total_revenue) AS s FROM gold_daily_revenue WHERE order_date < DATE '2024-11-01'), a AS (SELECT avg(total_revenue) AS m FROM gold_daily_revenue),
r(rule_id, bad) AS (
  SELECT 'gold_daily_revenue_row_count', (n - 120) / 120 * 100 NOT BETWEEN -30 AND 50 FROM n
  UNION ALL SELECT 'gold_freshness_check', max(computed_at) < TIMESTAMP '2024-12-15 22:00:00' FROM gold_daily_revenue
  UNION ALL SELECT 'gold_revenue_distribution', abs((a.m - o.m) / o.s) > 2.5 OR {_BANDS} > 20 FROM a, o
)
SELECT rule_id, n AS total_records, CASE WHEN bad THEN n ELSE 0 END AS failed_records, NOT bad AS passed, 'critical' AS severity FROM r, n""",
    "rule_outcomes": """SELECT * FROM (VALUES ('SKIPPED_NotNull', 0, 0, true, 'warning'), ('UNKNOWN__Unknown', 0, 0, false, 'warning'), ('no_column', 0, 0, false, 'critical'), ('no_parent', 0, 0, false, 'warning'), ('ERROR_DistributionAnomaly', 0, 0, false, 'critical')) v(rule_id, total_records, failed_records, passed, severity)
UNION ALL SELECT 'fine', count(*), count(*) - count(order_id), count(*) = count(order_id), 'warning' FROM silver_orders""",
    "rule_samples": f"""(SELECT DISTINCT 'currency_known' AS rule_id, currency AS value FROM silver_orders WHERE {_BAD_CURRENCY} ORDER BY 2 LIMIT 20)
UNION ALL (SELECT DISTINCT 'customer_known', customer_id FROM silver_orders WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM silver_customers WHERE customer_id IS NOT NULL) ORDER BY 2 LIMIT 20)""",
    "rule_distribution_approximate": "SELECT * FROM (VALUES ('p25', true), ('p50', true), ('p75', true)) v(band, within_error)",
    "engine_summary": f"""WITH b AS (SELECT passed, severity FROM ({_rules_bronze()})),
s AS (SELECT count(*) FILTER (customer_id IS NULL) = 0 AS n, max(ingestion_timestamp) >= TIMESTAMP '2024-12-15 20:00:00' AS f, (SELECT x = 0 FROM ({_DUPES})) AS d FROM silver_orders),
g AS (SELECT max(computed_at) >= TIMESTAMP '2024-12-15 22:00:00' AS f FROM gold_daily_revenue),
l AS (
  SELECT 'bronze' AS layer, passed, severity FROM b UNION ALL SELECT 'silver', n, 'critical' FROM s UNION ALL SELECT 'silver', d, 'critical' FROM s UNION ALL SELECT 'silver', d, 'critical' FROM s UNION ALL SELECT 'silver', f, 'warning' FROM s
  UNION ALL SELECT 'silver', true, 'warning' UNION ALL SELECT 'silver', true, 'warning' UNION ALL SELECT 'gold', true, 'critical' UNION ALL SELECT 'gold', f, 'critical' FROM g UNION ALL SELECT 'gold', true, 'critical'
)
SELECT layer, CAST(count(*) AS INTEGER) AS total_rules, CAST(count(*) FILTER (passed) AS INTEGER) AS passed, CAST(count(*) FILTER (NOT passed) AS INTEGER) AS failed, round(100.0 * count(*) FILTER (passed) / count(*), 4)::DOUBLE AS pass_rate,
  CAST(count(*) FILTER (NOT passed AND severity = 'critical') AS INTEGER) AS critical_failures, CAST(count(*) FILTER (NOT passed AND severity = 'warning') AS INTEGER) AS warnings, count(*) FILTER (NOT passed AND severity = 'critical') > 0 AS should_quarantine, true AS same_run
FROM l GROUP BY 1""",
    "contract_report": f"""WITH p AS (SELECT count(order_id) = count(*) AND count(customer_id) = count(*) AND count(product_id) = count(*) AND count(*) >= 50 AND (SELECT g = 0 FROM ({_DUPES})) AS q, max(ingestion_timestamp) >= TIMESTAMP '2024-12-15 20:00:00' AS f FROM silver_orders)
SELECT 'schema' AS part, false AS passed UNION ALL SELECT 'quality', q FROM p UNION ALL SELECT 'freshness', f FROM p UNION ALL SELECT 'overall', false""",
    "silver_without_rejected": f"SELECT order_id, quantity, currency, source_file FROM silver_orders WHERE order_id IS NULL OR order_id NOT IN (SELECT order_id FROM silver_orders WHERE order_id IS NOT NULL AND {_marks(_STRICT)} <> '')",
    "quarantine_table": f"""SELECT order_id, customer_id, product_id, order_status, quantity, unit_price, currency, strftime(order_timestamp, '%Y-%m-%d %H:%M:%S') AS order_timestamp, '2024-12-16 00:00:00' AS _quarantine_timestamp, 'run-1' AS _quarantine_run_id, 'silver' AS _quarantine_layer, 'bronze_raw_events' AS _quarantine_dataset, reasons AS _quarantine_reasons
FROM (SELECT *, {_marks({'order_id_null': 'order_id IS NULL', **_REJECTED})} AS reasons FROM silver_orders) WHERE reasons <> ''""",
    "quarantine_capped": "SELECT least(n, 50) AS kept, greatest(n - 50, 0) AS left_out, least(n, 50) AS rows_read, n * 100 > 10 * 1000 AS over_limit FROM (SELECT count(*) AS n FROM silver_orders WHERE order_id IS NULL OR customer_id IS NULL OR product_id IS NULL OR order_timestamp IS NULL)",
    "store_versions": """SELECT 0 AS version, order_id, CAST(NULL AS INTEGER) AS quantity, CAST(NULL AS VARCHAR) AS extra FROM silver_orders
UNION ALL SELECT 2, order_id, quantity, NULL FROM silver_orders UNION ALL SELECT 2, order_id, NULL, currency FROM silver_orders WHERE quantity > 5""",
    "store_upsert": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0",
    "layer_tables": "SELECT layer, t AS table_name, '/base/' || t AS path FROM (VALUES " + ", ".join([f"('{t.split('_')[0]}', '{t}')" for t in CONTRACT_NAMES] + [f"('quarantine', 'quarantine_{x}')" for x in ("bronze", "silver", "gold")] + ["('observability', 'metrics')", "('observability', 'rule_results')"]) + ") v(layer, t)",
    "metrics_history": f"""WITH f AS (SELECT count(*) AS n, count(*) FILTER ({_BAD_CURRENCY}) AS x FROM silver_orders)
SELECT 'run-2' AS run_id, 'bronze_raw_events' AS dataset_name, 'bronze' AS layer, 'bronze_currency_valid' AS rule_name, '1.0' AS rule_version, m AS metric_name, round(CASE m WHEN 'failure_rate' THEN x / n ELSE 100.0::DOUBLE * (1 - x / n) END, 6) AS metric_value,
  x = 0 AS passed, 'warning' AS severity, n AS total_records, x AS failed_records, '2024-12-15 00:00:00' AS run_timestamp, 'orders' AS pipeline_name FROM f, (VALUES ('failure_rate'), ('pass_rate')) v(m)""",
    "metrics_long": _metrics_long(),
    "sql_all_checks": f"""SELECT 'orders_of_unknown_customers' AS check_name, count(*) = 0 AS passed FROM silver_orders WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM silver_customers WHERE customer_id IS NOT NULL)
UNION ALL SELECT 'lines_unique', count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem UNION ALL SELECT 'orders_unique', count(*) = count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'status_known', count(*) = 0 FROM silver_orders WHERE {_BAD_STATUS} UNION ALL SELECT 'order_there', count(*) = count(o_orderkey) FROM orders
UNION ALL SELECT 'orders_fresh', max(ingestion_timestamp) >= TIMESTAMP '2024-12-15' FROM silver_orders UNION ALL SELECT 'broken', NULL""",
    "generated_reference": f"""SELECT printf('PROD-%03d', i) AS product_id, printf('Product %03d', i) AS product_name, {_list_price("i")} AS list_price, NULL AS customer_id FROM range(1, {synth.PRODUCTS + 1}) t(i)
UNION ALL SELECT NULL, NULL, NULL, printf('CUST-%04d', i) FROM range(1, {synth.CUSTOMERS + 1}) t(i)""",
    "generated_events": f"WITH {_events()} SELECT * FROM events_made",
    "generated_faults": f"WITH {_events()}, {_faults()} SELECT * FROM faulty UNION ALL SELECT * FROM copies",
    "silver_rejections": f"SELECT {_marks({'order_id_null': 'order_id IS NULL', **_REJECTED})} AS reasons, count(*) AS record_count FROM silver_orders GROUP BY 1 HAVING reasons <> ''",
    "silver_customers": f"""WITH used AS (SELECT customer_id, currency, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, currency) AS rn FROM silver_orders WHERE currency IS NOT NULL GROUP BY 1, 2),
totals AS (SELECT customer_id, min(order_date) AS first_order_date, max(order_date) AS last_order_date, count(*) AS total_orders, {_SUM} AS total_spend, {_MEAN} AS avg_order_value FROM silver_orders GROUP BY 1)
SELECT t.*, u.currency AS preferred_currency FROM totals t LEFT JOIN used u ON u.customer_id IS NOT DISTINCT FROM t.customer_id AND u.rn = 1""",
    "silver_products": f"SELECT product_id, CAST(sum(quantity) AS BIGINT) AS total_quantity_sold, {_SUM} AS total_revenue, CAST(sum({_PRICE}) AS DOUBLE) / nullif(count({_PRICE}), 0) AS avg_unit_price, min(unit_price) FILTER (NOT isnan(unit_price)) AS min_unit_price, max(unit_price) FILTER (NOT isnan(unit_price)) AS max_unit_price, count(*) AS order_count, max(order_date) AS last_sold_date FROM silver_orders GROUP BY 1",
    "gold_daily_revenue": f"SELECT order_date, currency, {_SUM} AS total_revenue, count(*) AS order_count, {_MEAN} AS avg_order_value, count(DISTINCT customer_id) AS unique_customers, count(DISTINCT product_id) AS unique_products FROM silver_orders GROUP BY 1, 2",
    "gold_product_performance": f"""SELECT *, CAST(row_number() OVER (ORDER BY total_revenue DESC, product_id NULLS FIRST) AS INTEGER) AS revenue_rank FROM (
SELECT product_id, CAST(sum(quantity) AS BIGINT) AS total_quantity_sold, {_SUM} AS total_revenue, CAST(sum({_PRICE}) AS DOUBLE) / nullif(count({_PRICE}), 0) AS avg_unit_price, count(*) AS order_count,
  count(DISTINCT customer_id) AS unique_customers, min(order_date) AS first_sold_date, max(order_date) AS last_sold_date FROM silver_orders GROUP BY 1)""",
    "gold_customer_ltv": f"""SELECT *, CASE WHEN customer_tenure_days > 0 THEN round(total_orders / (customer_tenure_days / 30), 2) ELSE CAST(total_orders AS DOUBLE) END AS orders_per_month,
  CASE WHEN total_spend >= 500 THEN 'high' WHEN total_spend >= 100 THEN 'medium' ELSE 'low' END AS ltv_segment
FROM (SELECT customer_id, count(*) AS total_orders, {_SUM} AS total_spend, {_MEAN} AS avg_order_value, min(order_date) AS first_order_date, max(order_date) AS last_order_date, CAST(max(order_date) - min(order_date) AS INTEGER) AS customer_tenure_days FROM silver_orders GROUP BY 1)""",
    "quarantine_summary": f"""SELECT 'silver_orders' AS dataset_name, reasons, count(*) AS record_count, min(ingestion_timestamp) AS first_quarantined, max(ingestion_timestamp) AS last_quarantined, CAST(1 AS BIGINT) AS run_count
FROM (SELECT DISTINCT {_ALL}, {_marks(_STRICT)} AS reasons FROM silver_orders) WHERE reasons <> '' GROUP BY reasons""",
    "metric_trend": "SELECT run_timestamp, run_id, rule_name, metric_value, passed FROM metrics WHERE metric_name = 'failure_rate' AND dataset_name = 'silver_orders' ORDER BY run_timestamp DESC NULLS LAST, run_id DESC NULLS LAST, rule_name DESC NULLS LAST, metric_value DESC NULLS LAST LIMIT 10",
    "sql_referential_integrity": "SELECT product_id, count(*) AS orphan_count FROM silver_orders o WHERE product_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM silver_products p WHERE p.product_id = o.product_id) GROUP BY 1",
    "sql_uniqueness": "SELECT l_orderkey, l_linenumber, count(*) AS occurrence_count FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 100",
    "sql_accepted_values": f"SELECT order_status, count(*) AS violation_count FROM silver_orders WHERE {_BAD_STATUS} GROUP BY 1",
    "sql_not_null": "SELECT 'customer_id' AS column_name, count(*) AS total_records, count(*) - count(customer_id) AS null_count, round((count(*) - count(customer_id)) * 100.0::DOUBLE / count(*), 2) AS null_percentage FROM silver_orders",
    "sql_freshness": "SELECT round(h, 2) AS age_hours, 24.0::DOUBLE AS sla_hours, CASE WHEN h <= 24 THEN 'PASS' ELSE 'FAIL - SLA BREACH' END AS status FROM (SELECT date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01') / 3.6e9 AS h FROM events)",
    "sql_row_count_trend": """WITH counts AS (SELECT max(run_timestamp) AS run_timestamp, dataset_name, CAST(max(total_records) AS DOUBLE) AS row_count FROM metrics WHERE run_id IS NOT NULL AND dataset_name = 'silver_orders' GROUP BY run_id, dataset_name),
lagged AS (SELECT *, lag(row_count) OVER (PARTITION BY dataset_name ORDER BY run_timestamp, row_count) AS prev_count FROM counts)
SELECT *, round((row_count - prev_count) / nullif(prev_count, 0) * 100, 2) AS pct_change FROM lagged ORDER BY run_timestamp DESC, dataset_name, row_count LIMIT 30""",
    "sql_quality_dashboard": """WITH latest AS (SELECT dataset_name, arg_max(run_id, (run_timestamp, run_id)) AS run_id FROM metrics GROUP BY 1)
SELECT m.dataset_name, m.layer, m.rule_name, m.metric_name, round(m.metric_value, 4) AS metric_value, m.passed, m.severity, m.total_records, m.failed_records, m.run_timestamp
FROM metrics m JOIN latest l ON m.dataset_name = l.dataset_name AND m.run_id = l.run_id
WHERE m.metric_name IN ('failure_rate', 'pass_rate', 'null_rate', 'freshness_lag_hours', 'distribution_z_score', 'row_count_delta_pct')""",
    "generated_drift": "SELECT * FROM (VALUES ('v2', 'added_columns', 'loyalty_tier'), ('v3', 'removed_columns', 'currency'), ('v4', 'type_changes', 'quantity')) v(version, change, column_name)",
}
