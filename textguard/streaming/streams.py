"""Streams (T1-T10). Each takes a streaming DataFrame and returns one, or starts a query.

State is bounded: watermarks drop old keys, and the custom states keep at most a limiter's stamps or a conversation's last twelve
lines. Where ``ordered`` is asked for, rows wait until the watermark has passed them, so that they are taken in event order whatever
order they arrive in (:mod:`textguard.streaming.ordered`).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textguard.functions.arrays import same_key, settle
from textguard.operators import phrases
from textguard.operators.cascade import lexical_scorer, moderate
from textguard.operators.normalize import normalize
from textguard.operators.policy import held
from textguard.plans.quota import PER_DAY, PER_MINUTE, Quota
from textguard.sources.sinks import exists, latest
from textguard.streaming import ordered as in_order_of_time


# Tasks get these functions by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: How long a silent key's state is kept.
FORGET_MS = 30 * 24 * 3600 * 1000


def in_order(batches: Iterator[pd.DataFrame], order: str | list[str]) -> pd.DataFrame | None:
    """A key's rows of one micro-batch, sorted. They come in several Arrow batches, of which each by itself says nothing about order."""
    frames = [b for b in batches if len(b)]
    return pd.concat(frames).sort_values(order, kind="stable") if frames else None


def stream_moderate(stream: DataFrame, text: str = "text", sensitivity: str = "balanced", scorer=lexical_scorer, typos: dict[str, str] | None = None) -> DataFrame:
    """The batch verdict on every arriving message; stateless."""
    return moderate(stream, text, scorer, typos=typos).withColumn("held", F.expr(held(sensitivity)))


def once(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def offer_once(stream: DataFrame, ts: str = "ts", delay: str = "1 day", text: str = "text") -> DataFrame:
    """Help is offered once per distinct text. The watermark bounds what is remembered."""
    df = normalize(stream, text)
    marked = phrases.distress_hits(phrases.phrase_hits(phrases.with_found(df), ["self_harm", "distress"]))
    # The phrases that tell distress are looked for first: the tiers judge only the messages that have one.
    verdicts = moderate(settle(marked).filter("distress").select(*df.columns), text)
    return once(verdicts.filter("distress"), ["squashed"], ts, delay)


def cover_once(stream: DataFrame, key: str, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """A covered message counts once per identity."""
    return once(stream, [key], ts, delay)


def rate_limit(stream: DataFrame, key: str, at: str, tie: str, per_minute: int = PER_MINUTE, per_day: int = PER_DAY,
               ordered: bool = False, delay: str = "1 day") -> DataFrame:
    """T4: the quota over a stream. ``at`` is in microseconds, and requests are taken in event order
    within a micro-batch. The state is the limiter's stamps and the day's count.

    With ``ordered``, requests wait until the watermark passes them and are taken in event order over all micro-batches.
    """
    columns = [f.name for f in stream.schema.fields]
    schema = stream.schema.simpleString()[len("struct<"):-1] + ",granted:boolean"

    def decide(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps, day, used = state.get if state.exists else ([], -1, 0)
        quota = Quota(per_minute, per_day, stamps, day, used)
        batch = in_order(batches, [at, tie])
        if batch is not None:
            yield batch[columns].assign(granted=[quota.request(int(t)) for t in batch[at]])
        state.update((list(quota.stamps), quota.day, quota.used))

    if ordered:
        return in_order_of_time.limited(stream, key, at, tie, per_minute, per_day, delay)
    return stream.groupBy(key).applyInPandasWithState(
        decide, schema, "stamps array<bigint>, day bigint, used bigint", "append", GroupStateTimeout.NoTimeout)


def allow_ttl(messages: DataFrame, allows: DataFrame, key: str, ts: str = "ts", ttl: str = "600 seconds", delay: str = "10 minutes") -> DataFrame:
    """T5: messages no allow of their key covers, by an outer interval join of two streams.

    Allows are reduced first: of each key and each span as long as the time to live, the earliest and the latest decide, as in J7. So
    a message meets two rows at most, however many allows a key has. Unmatched messages come out once the watermark says that no
    allow can cover them any more.
    """
    span = F.window("a_ts", ttl)
    per = (allows.select(F.col(key).alias("a_key"), F.col(ts).alias("a_ts")).withWatermark("a_ts", delay).groupBy("a_key", span.alias("w"))
           .agg(F.min("a_ts").alias("lo"), F.max("a_ts").alias("hi")).select("a_key", "lo", "hi", F.window_time("w").alias("a_end")))
    # window_time is the last microsecond of a span.
    meets = F.expr(f"m.{key} = a_key AND m.{ts} > a_end - INTERVAL {ttl} AND m.{ts} <= a_end + INTERVAL {ttl} AND m.{ts} >= lo AND m.{ts} <= hi + INTERVAL {ttl}")
    return messages.withWatermark(ts, delay).alias("m").join(per, meets, "left_outer").filter("a_end IS NULL").drop("a_key", "lo", "hi", "a_end")


def stream_sessions(stream: DataFrame, key: str, app: str, ts: str = "ts", gap: str = "120 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sessions that end after a pause, per key and application."""
    return (stream.withWatermark(ts, delay).groupBy(key, app, F.session_window(ts, gap).alias("w"))
            .agg(F.count("*").alias("edits"))
            .select(key, app, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "edits"))


def open_sessions(df: DataFrame, key: str, app: str, watermark: str, ts: str = "ts", gap: str = "120 seconds") -> DataFrame:
    """T6, what a stream over these rows still holds: the sessions that a row after ``watermark`` (an SQL timestamp) could still join.

    ``df`` is a batch frame of all rows so far; the closed sessions are the other ones of :func:`stream_sessions` on it.
    """
    every = (df.groupBy(key, app, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("edits"))
             .select(key, app, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "edits"))
    return every.filter(f"ended > {watermark}")


#: The counters of a day: from what kind of event, or what tier of trace.
OUTCOMES = {"caught": "caught", "rewritten": "rephrased", "dropped": "deleted", "sent_anyway": "sent_anyway", "covered": "covered"}
TIER_COUNTERS = {"tier_rules": "rules", "tier_device": "on_device", "tier_context": "context"}


def stream_daily_rollup(stream: DataFrame, ts: str = "occurred_at", delay: str = "2 days") -> DataFrame:
    """Running day counters per install, in update mode. Where the stream has a ``tier`` (of traces, whose kind is null), tiers are counted too."""
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(n) for n, k in OUTCOMES.items()]
    if "tier" in stream.columns:
        counts += [F.count(F.when(F.col("tier") == t, 1)).alias(n) for n, t in TIER_COUNTERS.items()]
    return (stream.withWatermark(ts, delay).groupBy("install_id", F.window(ts, "1 day").alias("w"))
            .agg(*counts, F.max(ts).alias("updated_at"))
            .withColumn("day", F.to_date("w.start")).drop("w"))


def daily_rollup_table(spark: SparkSession, path: str) -> DataFrame:
    """The pushed table: the newest snapshot of each install and day. Counters only grow, and each batch writes a snapshot of its own."""
    rows = spark.read.parquet(path)
    return latest(rows, ["install_id", "day"], "batch_id").drop("batch_id", "digest")


def push_snapshot(batch: DataFrame, batch_id: int, path: str) -> None:
    """One micro-batch of counters into the table, as the partitions (day, batch).

    What an earlier batch already said in the same counters is skipped. Running a batch again writes the same partitions
    again: earlier batches alone are compared with, so a replay, or a run that was killed half-way, ends in the same table.
    """
    spark = batch.sparkSession
    counters = [c for c in batch.columns if c not in ("install_id", "day", "updated_at")]
    rows = batch.withColumn("digest", F.xxhash64(*counters))
    if exists(spark, path):
        days = F.broadcast(batch.select("day").distinct())  # at most one row per calendar day
        before = spark.read.parquet(path).filter(F.col("batch_id") < batch_id).join(days, "day", "left_semi")
        sent = before.groupBy("install_id", "day").agg(F.max_by("digest", "batch_id").alias("_sent"))
        rows = same_key(rows, sent, ["install_id", "day"], "left").filter(~F.col("digest").eqNullSafe(F.col("_sent"))).drop("_sent")
    rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path)


def push_daily_rollup(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """T7 into the daily table, which :func:`daily_rollup_table` reads: each micro-batch holds only the counters that changed."""
    return (stream_daily_rollup(stream).writeStream.outputMode("update").foreachBatch(lambda batch, n: push_snapshot(batch, n, path))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "300 seconds"})).start())


def late_policy(stream: DataFrame, ts: str = "occurred_at", received: str = "received_at", limit: str = "1 DAY") -> tuple[DataFrame, DataFrame]:
    """T8, by each row's own time of arrival: (rows in time, rows more than ``limit`` late). A row without one of the times is late."""
    in_time = F.expr(f"coalesce({ts} > {received} - INTERVAL {limit}, false)")
    return stream.filter(in_time), stream.filter(~in_time)


def split_late(batch: DataFrame, batch_id: int, ts: str, limit: str, accepted: str, quarantine: str, ledger: str, received: str | None = None) -> None:
    """One micro-batch parted into the accepted and the quarantine table, and its line in the ledger.

    Without ``received``, a row is late when its time is not after the watermark: the latest time of all earlier batches less ``limit``.
    All three tables are written by batch, so running a batch again leaves them as they are. Counts come from the writes themselves.
    """
    spark = batch.sparkSession
    before = spark.read.parquet(ledger).filter(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0] if exists(spark, ledger) else None
    mark = None if received else before
    if received:
        in_time, late = late_policy(batch, ts, received, limit)
    else:
        fine = F.col(ts).isNotNull() & (F.lit(mark is None) | (F.col(ts).cast("timestamp") > F.timestamp_micros(F.lit(mark or 0)) - F.expr(f"INTERVAL {limit}")))
        in_time, late = batch.filter(fine), batch.filter(~fine)
    latest_at = F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("latest")
    counted = {}
    for rows, path, name in ((in_time, accepted, "accepted"), (late, quarantine, "late")):
        seen = Observation(name)
        rows.observe(seen, F.count(F.lit(1)).alias("n"), latest_at).withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        counted[name] = seen.get
    times = [t for t in (before, *(c["latest"] for c in counted.values())) if t is not None]
    line = [(mark, max(times, default=None), counted["accepted"]["n"], counted["late"]["n"], batch_id)]
    spark.createDataFrame(line, "watermark bigint, latest bigint, accepted bigint, late bigint, batch_id bigint").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(ledger)


def push_late_split(stream: DataFrame, folder: str, checkpoint: str, ts: str = "occurred_at", limit: str = "1 DAY", received: str | None = None, **trigger) -> StreamingQuery:
    """The stream parted into ``folder``/accepted and ``folder``/quarantine; ``folder``/ledger has each batch's watermark and counts.

    Events are late after a day, daily rows (``ts`` their day) after two: ``limit``.
    """
    return (stream.writeStream.outputMode("append").foreachBatch(
        lambda batch, n: split_late(batch, n, ts, limit, f"{folder}/accepted", f"{folder}/quarantine", f"{folder}/ledger", received))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "300 seconds"})).start())


def stream_context(stream: DataFrame, key: str, order: str, text: str = "text", n: int = 12, ts: str | None = None, delay: str = "1 day",
                   ordered: bool = False, width: str | None = None) -> DataFrame:
    """Every message with the last twelve lines of its conversation before it.

    Within a micro-batch lines are taken by ``order``, from one micro-batch to the next as they arrive. With an event
    time ``ts``, a conversation over which the watermark has passed by 30 days is forgotten; without, each key keeps n lines for good.

    With ``ordered`` (and ``ts``), messages wait until the watermark passes them and are taken by event time, then ``order``, over all
    micro-batches; what is more than ``delay`` late is dropped. ``width`` is how much event time comes out at once.
    """
    if ordered and not ts:
        raise ValueError("an order over micro-batches needs an event time")
    columns = [f.name for f in stream.schema.fields]
    schema = stream.schema.simpleString()[len("struct<"):-1] + ",context:array<string>"

    def remember(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        lines = list(state.get[0]) if state.exists else []
        batch = in_order(batches, order)
        if batch is not None:
            contexts = []
            for line in batch[text]:
                contexts.append(list(lines))
                lines = [*lines, line][-n:]
            yield batch[columns].assign(context=contexts)
        state.update((lines,))
        if ts:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + FORGET_MS)

    if ordered:
        return in_order_of_time.context(stream, key, [order] if isinstance(order, str) else order, text, n, ts, delay, width)
    watched, timeout = (stream.withWatermark(ts, delay), GroupStateTimeout.EventTimeTimeout) if ts else (stream, GroupStateTimeout.NoTimeout)
    return watched.groupBy(key).applyInPandasWithState(remember, schema, "lines array<string>", "append", timeout)


def debounced_stream(stream: DataFrame, key: str, ts: str = "ts", text: str = "text", gap_seconds: float = 0.75,
                     delay: str = "10 seconds", ordered: bool = False, tie: list[str] | None = None, width: str | None = None,
                     short_gap_seconds: float | None = None) -> DataFrame:
    """A draft comes out once no newer edit of its key followed within the gap.

    Edits waiting in state are at most one per key; event time wakes them up. An edit that arrives after a newer one never replaces it;
    it comes out by itself if the newer one is no sooner than the gap.

    With ``ordered``, all edits wait until the watermark has passed them by the gap, so the drafts are those of the whole key in event
    order (of edits at one moment, the last by ``tie``, or else by text); what is late by more than ``delay`` and the shortest gap is dropped.
    ``short_gap_seconds`` is the gap of a draft whose last word is complete. ``tie`` columns come out beside the draft. No Python runs then.
    """
    if ordered:
        tie = tie or []
        found = in_order_of_time.settled(stream.select(key, ts, text, *tie), key, tie or [text], text, gap_seconds, ts, delay, short_gap_seconds, width)
        return found.select(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("at_ms"), text, *tie)
    if tie or short_gap_seconds is not None:
        raise ValueError("ties and the short gap need ordered=True")
    gap = int(gap_seconds * 1000)
    key_type = stream.schema[key].dataType.simpleString()
    watched = stream.withWatermark(ts, delay)

    def settle(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, draft = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "at_ms": [at], text: [draft]})
            return
        pending = state.get if state.exists else None
        out, late, batch = [], None, in_order(batches, ts)
        if batch is not None:
            for at, draft in zip(batch[ts].astype("datetime64[ms]").astype("int64"), batch[text]):
                if pending and at < pending[0]:
                    if late and at - late[0] >= gap:
                        out.append((k[0], *late))
                    late = (int(at), draft)
                    continue
                if late and pending[0] - late[0] >= gap:
                    out.append((k[0], *late))
                late = None
                if pending and at - pending[0] >= gap:
                    out.append((k[0], *pending))
                pending = (int(at), draft)
            if late and pending[0] - late[0] >= gap:
                out.append((k[0], *late))
        if pending is None:
            return
        state.update(pending)
        state.setTimeoutTimestamp(max(pending[0] + gap, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "at_ms", text])

    out_schema = f"{key} {key_type}, at_ms bigint, {text} string"
    return watched.groupBy(key).applyInPandasWithState(
        settle, out_schema, "at_ms bigint, draft string", "append",
        GroupStateTimeout.EventTimeTimeout)
