"""The request quota (T4): granted or denied, one request after the other."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.context import lookback
from textguard.plans.activity import HOUR, SECOND, micros, number_runs

# Tasks get these functions by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Requests per sliding minute and per day.
PER_MINUTE = 12
PER_DAY = 480


class Quota:
    """What a limiter remembers: at most ``per_minute`` stamps and the day's count."""

    def __init__(self, per_minute: int = PER_MINUTE, per_day: int = PER_DAY, stamps=(), day: int = -1, used: int = 0):
        self.per_minute, self.per_day = per_minute, per_day
        self.stamps, self.day, self.used = deque(stamps), day, used

    def request(self, at: int, outcome: str = "ok") -> bool:
        """A request at ``at`` microseconds. A denied one leaves no trace; one that fails gives its
        slot back; one the other side refuses uses up the minute."""
        day = at // (24 * HOUR)
        if day != self.day:
            self.day, self.used = day, 0
        while self.stamps and self.stamps[0] < at - 60 * SECOND:
            self.stamps.popleft()
        if self.used >= self.per_day or len(self.stamps) >= self.per_minute:
            return False
        if outcome != "failed":
            self.used += 1
            self.stamps.append(at)
        if outcome == "limited":
            self.stamps = deque([at] * self.per_minute)
        return True


def rate_limit(df: DataFrame, key: str, ts: str, tie: str, per_minute: int = PER_MINUTE, per_day: int = PER_DAY,
               outcome: str | None = None) -> DataFrame:
    """T4 in batch: adds ``granted``.

    The rule is sequential, but it forgets: after a minute's silence only the day's count is
    left, and at midnight that goes too. A key is cut wherever a silent minute spans midnight, and
    the pieces are independent. Each is streamed in order through a task that keeps
    nothing but the limiter's few stamps, so a piece may be as long as it likes.
    """
    given = df.columns
    rows = df.withColumn("_t", micros(ts))
    rows = lookback(rows, key, "_t", 1, "_t", "_prev", HOUR, tie)
    day = 24 * HOUR
    rows = rows.withColumn("_start", F.expr(
        f"CASE WHEN size(_prev) = 0 THEN 1 WHEN _t - get(_prev, 0) > {60 * SECOND}"
        f" AND floor(_t / {day}) != floor(get(_prev, 0) / {day}) THEN 1 ELSE 0 END"))
    rows = number_runs(rows, key, "_t", tie, "_start", "_piece", HOUR).select(*given, "_t", "_piece")
    ordered = rows.repartition(key, "_piece").sortWithinPartitions(key, "_piece", "_t", tie)
    schema = df.withColumn("granted", F.lit(True)).schema

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, quota = None, Quota(per_minute, per_day)
        for batch in batches:
            outcomes = batch[outcome] if outcome else ["ok"] * len(batch)
            granted = []
            for k, piece, at, result in zip(batch[key], batch["_piece"], batch["_t"], outcomes):
                if (k, piece) != current:
                    current, quota = (k, piece), Quota(per_minute, per_day)
                granted.append(quota.request(int(at), result))
            yield batch[given].assign(granted=granted)

    return ordered.mapInPandas(decide, schema)
