"""Streams that take a key's rows in event order, whatever order they arrive in (T4, T9, T10). T10 needs no more than aggregations
(:func:`settled`); the others read row by row.

Event time is cut into buckets. A row that arrives goes into its bucket of the key and is not read again until the watermark has passed
the bucket, which a timer tells; then the bucket's rows come out in order and are gone. So what a micro-batch reads and writes of the
state grows with the rows that arrive or come out, not with those that wait.

What one call brings for a bucket is sorted and stored as a run, in pieces of ``PIECE_ROWS``; coming out, the runs are merged, one piece
of each in memory at a time. A hot key is never in memory whole.
"""

from __future__ import annotations

import heapq
import pickle
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textguard.functions.arrays import settle
from textguard.plans.activity import WORD_ENDED
from textguard.plans.quota import Quota

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: How long the last lines of a silent key are kept.
FORGET_MS = 30 * 24 * 3600 * 1000
#: Rows of a stored piece, and of a run that is sorted at once.
PIECE_ROWS, RUN_ROWS = 256, 16_384
#: Cells of a key that are looked at together where settled rows are told.
SPAN_CELLS = 4096
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_map_state(spark: SparkSession) -> None:
    """Map state and timers live in the RocksDB store; a query keeps the store it was first started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def millis(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.expr(f"unix_millis(timestamp_millis(0) + INTERVAL {interval})")).first()[0]


def bucket_width(spark: SparkSession, delay: str, width: str | None) -> int:
    return millis(spark, width) if width else max(1, millis(spark, delay) // 64)


def by_order(row: tuple, places: list[int]) -> tuple:
    """A sort key over some places of a row; nulls come first."""
    return tuple((row[p] is not None, row[p]) if row[p] is not None else (False,) for p in places)


class InOrder(StatefulProcessor):
    """Buckets and their timers. Rows are tuples of the input's columns, the last of which is the event time in microseconds.

    ``names`` are the columns that come out, ``places`` those of the order.
    """

    def __init__(self, names: list[str], places: list[int], width_ms: int):
        self.names, self.places, self.width = names, places, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "bucket bigint", "runs int")
        self.pieces = handle.getMapState("pieces", "bucket bigint, run int, piece int", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        some: list[tuple] = []
        for row in rows:
            some.append(tuple(row))
            if len(some) >= RUN_ROWS:
                self.store(some)
                some = []
        if some:
            self.store(some)
        return iter(())

    def store(self, rows: list[tuple]) -> None:
        buckets: dict[int, list[tuple]] = {}
        for row in rows:
            buckets.setdefault(row[-1] // 1000 // self.width, []).append(row)
        for bucket, some in buckets.items():
            found = self.runs.getValue((bucket,))
            run = found[0] if found else 0
            if not run:
                self.handle.registerTimer((bucket + 1) * self.width)
            some.sort(key=lambda r: by_order(r, self.places))
            for k in range(0, len(some), PIECE_ROWS):
                self.pieces.updateValue((bucket, run, k // PIECE_ROWS), (pickle.dumps(some[k:k + PIECE_ROWS]),))
            self.runs.updateValue((bucket,), (run + 1,))

    def run_of(self, bucket: int, run: int) -> Iterator[tuple]:
        """A run's rows; each piece is removed as it is read."""
        piece = 0
        while found := self.pieces.getValue((bucket, run, piece)):
            self.pieces.removeKey((bucket, run, piece))
            yield from pickle.loads(found[0])
            piece += 1

    def released(self, end: int) -> Iterator[tuple]:
        """The rows of the bucket that ends there, in order."""
        bucket = end // self.width - 1
        found = self.runs.getValue((bucket,)) if end % self.width == 0 else None
        if found:
            runs = [self.run_of(bucket, r) for r in range(found[0])]
            yield from heapq.merge(*runs, key=lambda r: by_order(r, self.places)) if len(runs) > 1 else runs[0]
            self.runs.removeKey((bucket,))

    def close(self) -> None:
        pass


class Context(InOrder):
    """Each row with the last lines before it."""

    def __init__(self, names: list[str], places: list[int], width_ms: int, text: int, n: int):
        super().__init__(names, places, width_ms)
        self.text, self.n = text, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lines = handle.getValueState("lines", "lines array<string>, seen bigint")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end, made = expiredTimerInfo.getExpiryTimeInMs(), Row(*self.names)
        held = self.lines.get()
        lines, seen = (list(held[0]), held[1]) if held else ([], None)
        if end % self.width:  # an odd one: time to forget, unless the key spoke again
            if seen is not None and forgotten(seen, self.width) <= end:
                self.lines.clear()
            return
        some = False
        for row in self.released(end):
            some = True
            yield made(*row[:-1], list(lines))
            lines = [*lines, row[self.text]][-self.n:] if self.n else []
        if some:
            if seen is not None:
                self.handle.deleteTimer(forgotten(seen, self.width))
            self.lines.update((lines, end))
            self.handle.registerTimer(forgotten(end, self.width))


def forgotten(seen: int, width: int) -> int:
    """When lines last added to at ``seen`` are dropped; never a bucket's end."""
    return (seen + FORGET_MS) // width * width + 1


class Limited(InOrder):
    """Each row with whether the quota grants it. The place ``at`` has the moment of the request."""

    def __init__(self, names: list[str], places: list[int], width_ms: int, at: int, per_minute: int, per_day: int):
        super().__init__(names, places, width_ms)
        self.at, self.per_minute, self.per_day = at, per_minute, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.used = handle.getValueState("used", "stamps array<bigint>, day bigint, used bigint")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, made, some = self.used.get(), Row(*self.names), False
        quota = Quota(self.per_minute, self.per_day, *((list(held[0]), held[1], held[2]) if held else ()))
        for row in self.released(expiredTimerInfo.getExpiryTimeInMs()):
            some = True
            yield made(*row[:len(self.names) - 1], quota.request(row[self.at]))
        if some:
            self.used.update((list(quota.stamps), quota.day, quota.used))


def timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """The stream with its watermark, and ``_at``: the event time in microseconds, whatever the session's time zone. Rows without one are dropped."""
    return stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))


def run(stream: DataFrame, key: str, processor: InOrder, schema: str) -> DataFrame:
    with_map_state(stream.sparkSession)
    return stream.groupBy(key).transformWithState(processor, schema, "append", "eventTime")


def schema_of(stream: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)


def context(stream: DataFrame, key: str, order: list[str], text: str, n: int, ts: str, delay: str, width: str | None = None) -> DataFrame:
    """Every row with ``context``: the last n values of ``text`` of its key before it, by event time, then ``order``, nulls first.

    ``width`` is the length of a bucket (default: a 64th of the delay); a row comes out at most so long after the watermark passed it. A key that is silent
    for 30 days starts anew.
    """
    spark, rows = stream.sparkSession, timed(stream, ts, delay)
    places = [rows.columns.index(c) for c in ["_at", *order]]
    return run(rows, key, Context([*stream.columns, "context"], places, bucket_width(spark, delay, width), rows.columns.index(text), n), f"{schema_of(stream)}, context array<string>")


def settled(stream: DataFrame, key: str, order: list[str], text: str, gap_seconds: float, ts: str, delay: str, short_gap_seconds: float | None = None,
            width: str | None = None) -> DataFrame:
    """The rows with no newer one of their key within the gap; of rows at one moment the last by ``order``.

    With ``short_gap_seconds``, a text that ends in a space or punctuation settles after that time already.

    No Python runs: both states are those of aggregations over event time, which the watermark closes. The first keeps one row for each key and cell, a
    cell being as long as the shortest gap: of its rows only the last can settle, and what came before it asks only when the first came. The second
    looks at the cells of a key in a span, with those of the gap behind it, so a span needs no other.
    """
    spark = stream.sparkSession
    with_map_state(spark)
    gap = round(gap_seconds * 1_000_000)
    short = gap if short_gap_seconds is None else round(short_gap_seconds * 1_000_000)
    needed = F.lit(gap)
    if short != gap:
        needed = F.when(F.right(F.col(text), F.lit(1)).rlike(WORD_ENDED), short).otherwise(gap)
    rows = timed(stream, ts, delay).withColumn("_until", F.col("_at") + needed)
    at_once = rows.where("_until <= _at").select(*stream.columns)  # of a gap of nothing
    if max(gap, short) <= 0:
        return at_once
    cell = min(g for g in (gap, short) if g > 0)
    halo = -(-max(gap, short) // cell) * cell
    # A span holds whole cells, and not more of them than a row of the state should.
    span = max(halo, min(-(-bucket_width(spark, delay, width) * 1000 // cell), SPAN_CELLS) * cell)
    last = F.max_by(F.struct(*stream.columns, "_at", "_until"), F.struct(*dict.fromkeys(["_at", *order, text])))
    cells = (rows.groupBy(F.col(key).alias("_key"), F.window(ts, f"{cell} microseconds").alias("_cell"))
             .agg(F.min("_at").alias("_first"), last.alias("_last"))
             .select("_key", F.window_time("_cell").alias("_when"), "_first", "_last"))
    spans = (cells.groupBy("_key", F.window("_when", f"{span + halo} microseconds", f"{span} microseconds").alias("_span"))
             .agg(F.array_sort(F.collect_list(F.struct("_first", "_last"))).alias("_cells"))
             .select("_cells", (F.unix_micros("_span.start") + span).alias("_end")))
    alone = "filter(_cells, (c, i) -> c._first < _end AND c._last._until > c._last._at AND coalesce(get(_cells, i + 1)._first >= c._last._until, true))"
    found = settle(spans).select(F.explode(F.expr(alone)).alias("_c")).select(*[F.col("_c._last")[c].alias(c) for c in stream.columns])
    return found if min(gap, short) > 0 else found.unionByName(at_once)


def limited(stream: DataFrame, key: str, at: str, tie: str, per_minute: int, per_day: int, delay: str, width: str | None = None) -> DataFrame:
    """Every row with ``granted``: the quota over each key's requests by ``at`` (microseconds), then ``tie``, nulls first. Rows without a moment are dropped."""
    spark, rows = stream.sparkSession, timed(stream.withColumn("_ts", F.timestamp_micros(at)), "_ts", delay)
    places = [rows.columns.index(c) for c in ["_at", tie]]
    return run(rows, key, Limited([*stream.columns, "granted"], places, bucket_width(spark, delay, width), rows.columns.index(at), per_minute, per_day),
               f"{schema_of(stream)}, granted boolean")
