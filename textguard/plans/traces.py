"""A trace of every finished analysis, and its figures as a by-product of writing it.

The figures are observed on the rows as they pass (``observe``), so they cost no pass of their own: in a batch job through an
``Observation``, in a stream through a listener that adds up what each micro-batch reports. There are four tiers, so a handful of
numbers reach the driver however many traces there are.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from textguard.plans.activity import TIERS

#: Fixed value: so much of a text is kept in its trace.
SNIPPET = 140
TELEMETRY = "tier string, n bigint, latency_sum double, latency_avg double, escalated bigint, share double"


def trace_rows(verdicts: DataFrame, key: str, at: str, text: str = "text") -> DataFrame:
    """One trace per routed verdict (:func:`textguard.operators.cascade.cascade_route`): who answered, how, and how long it took.

    ``escalated`` is true where the reviewer's answer counts; ``held`` is false, as nothing has been done about it yet.
    """
    return verdicts.select(
        key, F.col(at).alias("occurred_at"), F.to_date(at).alias("day"), F.left(F.col(text), F.lit(SNIPPET)).alias("snippet"),
        "tier", "level", "score", "latency_ms", "rationale", "categories", F.coalesce("reviewed", F.lit(False)).alias("escalated"),
        F.lit(False).alias("held"), "distress", "source")


def metrics() -> list[Column]:
    """Per tier: analyses, their latency, and those that were escalated."""
    out = []
    for tier in TIERS:
        mine = F.col("tier") == tier
        out += [F.count_if(mine).alias(f"n_{tier}"), F.sum(F.when(mine, F.col("latency_ms"))).alias(f"latency_{tier}"),
                F.count_if(mine & F.col("escalated")).alias(f"escalated_{tier}")]
    return out


class Totals(StreamingQueryListener):
    """Adds up a stream's observed figures. A micro-batch that is reported again, as after a restart, counts once."""

    def __init__(self, name: str = "traces"):
        self.name, self.sums, self.seen = name, {}, {}
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get(self.name)
        query = str(progress.id)
        if found is None or progress.batchId <= self.seen.get(query, -1):
            return
        self.seen[query] = progress.batchId
        for figure, value in found.asDict().items():
            self.sums[figure] = self.sums.get(figure, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def telemetry(spark: SparkSession, found: dict[str, float]) -> DataFrame:
    """Observed figures as A4's table without the day: tier, n, latency_sum, latency_avg, escalated, share; tiers that answered nothing have no row."""
    total = sum(found.get(f"n_{t}") or 0 for t in TIERS)
    rows = [(t, n, float(found.get(f"latency_{t}") or 0), float(found.get(f"latency_{t}") or 0) / n, found.get(f"escalated_{t}") or 0, n / total) for t in TIERS if (n := found.get(f"n_{t}") or 0)]
    return spark.createDataFrame(rows, TELEMETRY)


def write_traces(traces: DataFrame, path: str) -> DataFrame:
    """Appends traces to the table in a folder, by day; returns the run's telemetry."""
    seen = Observation("traces")
    traces.observe(seen, *metrics()).write.mode("append").partitionBy("day").parquet(path)
    return telemetry(traces.sparkSession, seen.get)


def stream_traces(traces: DataFrame, path: str, checkpoint: str, name: str = "traces", **trigger) -> StreamingQuery:
    """Traces of a stream of verdicts into the table, each once; a :class:`Totals` on the session's streams sees the figures."""
    return (traces.observe(name, *metrics()).writeStream.outputMode("append").format("parquet").partitionBy("day").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "300 seconds"})).start())
