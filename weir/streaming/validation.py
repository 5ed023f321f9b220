"""Rules and late-event aggregates on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from weir.model import CheckResult, Rule
from weir.operators.metrics import MetricsStore
from weir.plans import fused


def validate_stream(stream: DataFrame, rules: Iterable[Rule], dataset: str, checkpoint: str, metrics: MetricsStore | None = None, on_results: Callable[[int, list[CheckResult]], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Checks every micro-batch as a bounded table; results go to the metrics and to ``on_results``."""
    rules = list(rules)

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            results = fused.checks(batch, rules, dataset)
        finally:
            batch.unpersist()
        if metrics is not None:
            metrics.write(results, f"batch-{number}", dataset)
        if on_results is not None:
            on_results(number, results)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def deduplicated(stream: DataFrame, keys: list[str], event_time: str, lateness: str) -> DataFrame:
    """Each key once within the watermark; state older than ``lateness`` is dropped."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_sums(stream: DataFrame, event_time: str, lateness: str, window: str, groups: list[str], amount: str) -> DataFrame:
    """Sums and counts per event-time window and group; late rows correct a window until the watermark
    has passed it. An amount that 28 digits cannot hold counts as a record and in ``unfit_amounts``."""
    return (
        stream.withWatermark(event_time, lateness)
        .groupBy(F.window(event_time, window), *groups)
        .agg(F.sum(F.col(amount).try_cast("decimal(28,2)")).alias("total_amount"), F.count(F.lit(1)).alias("record_count"), F.count_if(F.col(amount).isNotNull() & F.col(amount).try_cast("decimal(28,2)").isNull()).alias("unfit_amounts"))
        .select(F.col("window.start").alias("window_start"), *groups, "total_amount", "record_count", "unfit_amounts")
    )


def route_late(stream: DataFrame, event_time: str, arrival_time: str, lateness_hours: int = 72) -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows within the lateness, and those beyond it for quarantine. Rows without an
    event or arrival time count as late."""
    within = F.coalesce(F.col(arrival_time) - F.expr(f"INTERVAL {int(lateness_hours)} HOURS") <= F.col(event_time), F.lit(False))
    return stream.where(within), stream.where(~within)
