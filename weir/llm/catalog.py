"""The queries of this package by name, over whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import leakage, mixing, quantile_sketch, sentences
from weir.sources.tables import read_table


PROBABILITIES, ACCURACY = [0.01, 0.25, 0.5, 0.75, 0.99], 0.01


def _measures(spark: SparkSession, folder: str) -> DataFrame:
    """unit_price and quantity of every order as (measure, currency, order_day, v), in one scan."""
    orders = read_table(spark, folder, "silver_orders")
    pair = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in ("unit_price", "quantity")])
    return orders.select("currency", F.to_date("order_timestamp").alias("order_day"), F.explode(pair).alias("_m")).select("_m.measure", "currency", "order_day", "_m.v")


def _told(found: DataFrame) -> DataFrame:
    """Estimates to six places, bounds outwards to four; values beyond 1e14 as they are."""
    def outwards(name: str, step) -> Column:
        return F.when(F.abs(name) < 1e14, step(F.col(name) * 1e4) / F.lit(1e4)).otherwise(F.col(name))

    return found.withColumns({"estimate": F.round("estimate", 6), "lower_bound": outwards("lower_bound", F.floor), "upper_bound": outwards("upper_bound", F.ceil)})


def p3_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of unit_price and quantity per currency and order day, with bounds."""
    groups = ["measure", "currency", "order_day"]
    return _told(quantile_sketch.quantiles(quantile_sketch.sketch(_measures(spark, folder), "v", groups, ACCURACY), groups, PROBABILITIES, ACCURACY))


def _overall(spark: SparkSession, folder: str) -> DataFrame:
    daily = quantile_sketch.sketch(_measures(spark, folder), "v", ["measure", "currency", "order_day"], ACCURACY)
    return quantile_sketch.quantiles(quantile_sketch.merge(daily, ["measure", "currency"]), ["measure", "currency"], PROBABILITIES, ACCURACY)


def p3_overall(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per currency, from the sketches of the days."""
    return _told(_overall(spark, folder))


def p3_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The exact percentiles per currency, as far as they lie between the bounds of ``p3_overall``."""
    return quantile_sketch.exact_between(_measures(spark, folder), "v", ["measure", "currency"], _overall(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets")


def p7_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What every source of every mix is asked for and can give."""
    documents, targets = _mix(spark, folder)
    plan = mixing.demand(targets, mixing.supply(documents, "source", mixing.utf8_tokens(F.col("text"))))
    return plan.select("mix_id", "source", F.col("tokens").alias("supply_tokens"), F.round("given", 3).alias("given_tokens"))


#: Sources of small share come late: the weight of a source drifts by this much over the training.
DRIFT = 0.5


def _drift() -> Column:
    return F.when(F.col("share_permille") < 100, F.lit(DRIFT)).otherwise(F.lit(-DRIFT) * F.col("share_permille") / 1000)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose placed copies are used up before the training of ``p7_mix`` ends."""
    documents, targets = _mix(spark, folder)
    return mixing.placed_shortfalls(documents, targets, "doc_id", "source", mixing.utf8_tokens(F.col("text")), _drift())


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every copy of every mix with its training position, in order."""
    documents, targets = _mix(spark, folder)
    mix = mixing.curriculum(documents, targets, "doc_id", "source", mixing.utf8_tokens(F.col("text")), _drift())
    return mix.withColumn("position", F.round("position", 9))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixes reach."""
    documents, targets = _mix(spark, folder)
    tokens = mixing.utf8_tokens(F.col("text"))
    plan = mixing.demand(targets, mixing.supply(documents, "source", tokens))
    return mixing.actual_shares(mixing.curriculum(documents, targets, "doc_id", "source", tokens), plan)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(read_table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "end_pos")


QUERIES = {f.__name__: f for f in (p3_daily, p3_overall, p3_exact, p6_found, p7_found, p7_plan, p7_mix, p7_shares, p8_found)}

_VALUES = """
vals AS (
  SELECT 'unit_price' AS measure, currency, CAST(order_timestamp AS DATE) AS order_day, unit_price AS v FROM silver_orders WHERE NOT isnan(unit_price)
  UNION ALL SELECT 'quantity', currency, CAST(order_timestamp AS DATE), CAST(quantity AS DOUBLE) FROM silver_orders WHERE quantity IS NOT NULL
)"""


def _quantiles(groups: str) -> str:
    # The sketch's definition again: buckets of ratio 1.01 / 0.99, rank ceil(p * n). p3_exact checks it.
    g = f"({1 + ACCURACY} / {1 - ACCURACY})::DOUBLE"
    value = f"CASE WHEN s = 0 THEN 0 WHEN b = {quantile_sketch.INFINITE} THEN s * 'inf'::DOUBLE ELSE s * {{}} END"
    near, far = value.format(f"pow({g}, b - 1) * (1 - 1e-12)"), value.format(f"pow({g}, b - 1) * ({g} * (1 + 1e-12))")
    return f"""WITH {_VALUES},
sketch AS (SELECT measure, {groups}, sign(v) AS s, CASE WHEN v = 0 THEN 0 WHEN isinf(v) THEN {quantile_sketch.INFINITE} ELSE ceil(ln(abs(v)) / ln({g})) END AS b, count(*) AS n FROM vals GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY measure, {groups} ORDER BY s, s * b ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY measure, {groups}) AS total FROM sketch),
wanted AS (SELECT unnest({PROBABILITIES}::DOUBLE[]) AS probability),
found AS (
  SELECT measure, {groups}, probability, {value.format(f"pow({g}, b - 1) * (2 * {g} / ({g} + 1))")} AS e, least({near}, {far}) AS low, greatest({near}, {far}) AS high, CAST(total AS BIGINT) AS value_count
  FROM ranked, wanted WHERE greatest(1, ceil(probability * total)) <= upto AND greatest(1, ceil(probability * total)) > upto - n
)
SELECT measure, {groups}, probability, round(e, 6) AS estimate, CASE WHEN abs(low) < 1e14 THEN floor(low * 1e4) / 1e4 ELSE low END AS lower_bound, CASE WHEN abs(high) < 1e14 THEN ceil(high * 1e4) / 1e4 ELSE high END AS upper_bound, value_count FROM found"""


_SUPPLY = """
supply AS (SELECT lower(trim(source)) AS source, CAST(sum(strlen(text)) AS HUGEINT) AS tokens FROM documents GROUP BY 1),
plan AS (
  SELECT t.mix_id, lower(trim(t.source)) AS source, t.max_repeats, t.share_permille, t.budget_percent, coalesce(s.tokens, 0) AS tokens,
    CAST(t.share_permille AS HUGEINT) * t.budget_percent * (SELECT sum(tokens) FROM supply) AS wanted_x, CAST(t.max_repeats AS HUGEINT) * coalesce(s.tokens, 0) * 100000 AS ceiling_x
  FROM mix_targets t LEFT JOIN supply s ON s.source = lower(trim(t.source))
)"""

_MIX = f"""{_SUPPLY},
axis AS (
  SELECT source, doc_id, tokens, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, {mixing.BUCKET_DIGITS}), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM (SELECT lower(trim(source)) AS source, doc_id, coalesce(strlen(text), 0) AS tokens FROM documents WHERE source IS NOT NULL)
),
taken AS (
  SELECT p.mix_id, p.source, a.doc_id, a.tokens, CAST(a.begin AS DOUBLE) AS begin, CAST(p.tokens AS DOUBLE) AS supply, CAST(p.wanted_x AS DOUBLE) / 100000 AS wanted, least(CAST(p.wanted_x AS DOUBLE), CAST(p.ceiling_x AS DOUBLE)) / 100000 AS given,
    p.max_repeats, CASE WHEN p.share_permille < 100 THEN {DRIFT} ELSE -{DRIFT} * p.share_permille / 1000 END::DOUBLE AS d
  FROM plan p JOIN axis a USING (source) WHERE p.tokens > 0
),
copies AS (SELECT *, unnest(range(1, CAST(least(max_repeats, ceil((given - begin) / supply)) AS BIGINT) + 1)) AS copy_no FROM taken WHERE given > begin),
placed AS (SELECT *, least(1.0::DOUBLE, (begin + (copy_no - 1) * supply + tokens / 2.0::DOUBLE) / wanted) AS m FROM copies),
mix AS (SELECT mix_id, source, doc_id, copy_no, tokens, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (sqrt((1 - d) * (1 - d) + 4 * d * m) - (1 - d)) / (2 * d))) AS position FROM placed)"""

ORACLES = {
    "p3_daily": _quantiles("currency, order_day"),
    "p3_overall": _quantiles("currency"),
    "p3_exact": f"""WITH {_VALUES},
ranked AS (SELECT measure, currency, v, row_number() OVER (PARTITION BY measure, currency ORDER BY v) AS rank, count(*) OVER (PARTITION BY measure, currency) AS n FROM vals),
wanted AS (SELECT unnest({PROBABILITIES}::DOUBLE[]) AS probability)
SELECT measure, currency, probability, v AS exact FROM ranked, wanted WHERE rank = greatest(1, ceil(probability * n))""",
    "p7_mix": f"WITH {_MIX} SELECT mix_id, source, doc_id, copy_no, tokens, round(position, 9) AS position FROM mix",
    "p7_shares": f"""WITH {_MIX},
reached AS (SELECT mix_id, source, CAST(sum(tokens) AS BIGINT) AS taken_tokens, count(*) AS taken_copies, max(copy_no) AS repeats FROM mix GROUP BY 1, 2)
SELECT p.mix_id, p.source, p.share_permille, coalesce(taken_tokens, 0) AS taken_tokens, coalesce(taken_copies, 0) AS taken_copies, coalesce(repeats, 0) AS repeats,
  round(1000 * coalesce(taken_tokens, 0) / sum(coalesce(taken_tokens, 0)) OVER (PARTITION BY p.mix_id), 3) AS reached_permille
FROM plan p LEFT JOIN reached r USING (mix_id, source)""",
    "p7_found": f"WITH {_SUPPLY} SELECT mix_id, source FROM plan WHERE ceiling_x < wanted_x",
    "p7_plan": f"WITH {_SUPPLY} SELECT mix_id, source, CAST(tokens AS BIGINT) AS supply_tokens, round(least(CAST(wanted_x AS DOUBLE), CAST(ceiling_x AS DOUBLE)) / 100000, 3) AS given_tokens FROM plan",
}
