"""Activity events: gates, checks and event-time windows.

Windows along a key run over (key, time chunk) with a carry between chunks, as in
:mod:`textguard.operators.context`, so one key may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard import lexicon as L
from textguard.functions.arrays import same_key, within
from textguard.operators.context import lookback, newest

# What can happen to a message.
KINDS = ["caught", "rephrased", "edited", "deleted", "sent_anyway", "covered", "resources"]
TIERS = ["rules", "on_device", "context", "cache"]
SEVERITIES = ["Sharp", "Harsh", "Cruel"]
LEVELS = ["light", "balanced", "attentive"]

SECOND = 1_000_000  # event time is kept in microseconds
HOUR = 3600 * SECOND


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def excluded_apps(df: DataFrame, app: str = "app_id", deny: DataFrame | None = None) -> DataFrame:
    """F8: rows of applications that are never read are dropped.

    The built-in list is a literal set in the filter; a given list (column ``app_id``) is an
    anti-join that Spark broadcasts by itself while it is small.
    """
    if deny is None:
        return df.filter(F.expr(f"coalesce(NOT {within(app, L.EXCLUDED_APPS)}, true)"))
    return df.join(deny.select(F.col("app_id").alias(app)), app, "left_anti")


def length_gate(df: DataFrame, text: str = "text", lo: int = 2, hi: int = 2000, min_words: int = 0) -> DataFrame:
    """texts of lo to hi characters and at least so many words."""
    kept = F.char_length(text).between(lo, hi)
    if min_words:
        kept &= F.size(F.filter(F.split(text, " "), lambda w: w != "")) >= min_words
    return df.filter(kept)


def direction_filter(df: DataFrame, direction: str) -> DataFrame:
    """incoming events are covers, outgoing all others."""
    return df.filter("kind = 'covered'" if direction == "incoming" else "kind != 'covered'")


def consent_gate(df: DataFrame, installs: DataFrame) -> DataFrame:
    """only events of installs that share their statistics."""
    return df.join(installs.filter("share_stats").select("install_id"), "install_id", "left_semi")


# The row checks of each table. A check passes when it is null.
CHECKS = {
    "daily_stats": {
        **{f"{c} >= 0": f"{c} >= 0" for c in ("caught", "rewritten", "dropped", "sent_anyway", "covered",
                                             "tier_rules", "tier_device", "tier_context")},
        "sensitivity": within("sensitivity", LEVELS),
    },
    "installs": {
        "sensitivity": within("sensitivity", LEVELS),
        "passcode_complete": "(passcode_digest IS NULL) = (passcode_salt IS NULL)",
    },
    "events": {
        "kind": within("kind", KINDS),
        "score": "score BETWEEN 0 AND 1",
        "severity": within("severity", SEVERITIES),
        "tier": within("tier", TIERS),
        "text_length": "text_length >= 0",
    },
}


def with_violations(df: DataFrame, table: str) -> DataFrame:
    """Adds ``violations``: the names of the checks a row fails, in order."""
    failed = ", ".join(f"if(coalesce({test}, true), null, '{name}')" for name, test in CHECKS[table].items())
    return df.withColumn("violations", F.expr(f"array_compact(array({failed}))"))


def constraint_check(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with the checks they fail)."""
    checked = with_violations(df, table)
    return checked.filter("size(violations) = 0").drop("violations"), checked.filter("size(violations) > 0")


def referential_check(events: DataFrame, installs: DataFrame) -> DataFrame:
    """events of installs nobody knows."""
    return events.join(installs.select("install_id"), "install_id", "left_anti")


def cascade_delete(events: DataFrame, deleted: DataFrame) -> DataFrame:
    """events left once the deleted installs are gone."""
    return events.join(deleted.select("install_id").distinct(), "install_id", "left_anti")


def acceptance_window(df: DataFrame, as_of: str, table: str = "events", update: bool = False) -> DataFrame:
    """rows that arrive in time, judged against ``as_of`` (an SQL timestamp or date expression)."""
    if table == "events":
        return df.filter(f"occurred_at > {as_of} - INTERVAL 1 DAY")
    upper = "" if update else f" AND day <= date_add({as_of}, 1)"
    return df.filter(f"day >= date_add({as_of}, -2){upper}")


def metadata_projection(df: DataFrame, text: str = "text") -> DataFrame:
    """what may leave a machine: never the text, only its length and how it scored."""
    kept = [c for c in ("install_id", "kind", "occurred_at") if c in df.columns]
    return df.select(
        *kept, F.char_length(text).alias("text_length"),
        F.expr("least(greatest(score, 0e0), 1e0)").alias("score"),
        F.expr("CASE WHEN score > 0 THEN CASE WHEN score < 0.55e0 THEN 'Sharp' WHEN score < 0.78e0 THEN 'Harsh'"
               " ELSE 'Cruel' END END").alias("severity"))


def transition_filter(df: DataFrame, key: str, ts: str, value: str, tie: str, chunk: int = HOUR) -> DataFrame:
    """Rows whose value differs from the one before; a key's first row always stays."""
    seen = lookback(df.withColumn("_t", micros(ts)), key, "_t", 1, value, "_prev", chunk, tie)
    return seen.filter(f"size(_prev) = 0 OR NOT (get(_prev, 0) <=> {value})").drop("_t", "_prev")


#: A draft whose last word is complete: white space or punctuation follows it.
WORD_ENDED = r"[\p{P}\p{Z}\s]\z"


def debounce(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: float, chunk: int = HOUR, text: str | None = None,
             short_gap_seconds: float | None = None) -> DataFrame:
    """Rows with no newer edit of their key within the gap.

    With ``short_gap_seconds``, a ``text`` whose last word is complete settles after that time already.
    """
    back = df.withColumns({"_t": micros(ts), "_neg": -micros(ts), "_tie": -F.col(tie)})
    seen = lookback(back, key, "_neg", 1, "_t", "_next", chunk, "_tie")
    gap = str(round(gap_seconds * SECOND))
    if short_gap_seconds is not None:
        gap = f"if(coalesce({text} RLIKE r'{WORD_ENDED}', false), {round(short_gap_seconds * SECOND)}, {gap})"
    return seen.filter(f"size(_next) = 0 OR get(_next, 0) - _t >= {gap}").drop("_t", "_neg", "_tie", "_next")


def running_quota(df: DataFrame, key: str, ts: str, tie: str, per_minute: int = 12, per_day: int = 480) -> DataFrame:
    """How many requests of the key came in the minute up to each one (itself included), its
    place in the day, and whether that is over budget.

    A row looks back one minute, so each minute's rows are also sent to the next one as a halo.
    The place in the day is a place in the minute plus the count of the day's minutes before it.
    """
    rows = df.withColumns({"_t": micros(ts), "day": F.to_date(ts)})
    rows = rows.withColumn("_minute", F.floor(F.col("_t") / (60 * SECOND)))
    both = rows.withColumn("_halo", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "_bucket", F.expr("_minute + if(_halo, 1, 0)"))
    minute = Window.partitionBy(key, "_bucket").orderBy("_t")
    counted = (both.withColumn("in_minute", F.count("*").over(minute.rangeBetween(-60 * SECOND, 0)))
               .filter("NOT _halo"))
    placed = counted.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_minute").orderBy("_t", tie)))
    sums = rows.groupBy(key, "day", "_minute").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key, "day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n", "day")
    done = same_key(placed, offsets, [key, "_minute"]).withColumn("in_day", F.col("_place") + F.col("_before"))
    return done.withColumn("over_budget", F.expr(f"in_minute > {per_minute} OR in_day > {per_day}")).drop(
        "_t", "_minute", "_halo", "_bucket", "_place", "_before")


def recent_per_key(df: DataFrame, key: str, ts: str, tie: str, n: int = 60) -> DataFrame:
    """The newest n rows of every key."""
    return newest(df.withColumn("_t", micros(ts)), key, "_t", n, tie).drop("_t")


def number_runs(df: DataFrame, key: str, order: str, tie: str, starts: str, out: str, chunk: int) -> DataFrame:
    """Numbers runs along a key: a running sum of the 0/1 column ``starts``.

    The sum is taken per chunk and shifted by the starts of the chunks before it.
    """
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    inside = Window.partitionBy(key, "_chunk").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(key, "_chunk").agg(F.sum(starts).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    return (same_key(df.withColumn(out, F.sum(starts).over(inside)), offsets, [key, "_chunk"])
            .withColumn(out, F.col(out) + F.col("_before")).drop("_before"))


def typing_sessions(df: DataFrame, key: str, app: str, ts: str, text: str, tie: str, gap_seconds: int = 120,
                    keep: int = 800, chunk: int = HOUR) -> DataFrame:
    """A new session when the application changes or typing pauses; its last characters.

    Session numbers are a running sum, taken per chunk and then shifted by what came before the
    chunk. Of each session's text only the end is kept: within a chunk, rows beyond the last
    ``keep`` characters are dropped before the session is put together.
    """
    rows = df.select(key, app, ts, text, tie, micros(ts).alias("_t"))
    rows = rows.withColumn("_here", F.struct(F.col(app).alias("app"), F.col("_t").alias("t")))
    rows = lookback(rows, key, "_t", 1, "_here", "_prev", chunk, tie)
    rows = rows.withColumn("_new", F.expr(
        f"CASE WHEN size(_prev) = 0 OR get(_prev, 0).app != {app} OR _t - get(_prev, 0).t > {gap_seconds * SECOND}"
        " THEN 1 ELSE 0 END"))
    rows = number_runs(rows, key, "_t", tie, "_new", "session", chunk)

    counts = rows.groupBy(key, "session").agg(
        F.min(app).alias(app), F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("edits"))

    def from_the_end(*group: str) -> Column:
        back = Window.partitionBy(*group).orderBy(F.col("_t").desc(), F.col(tie).desc())
        return F.coalesce(F.sum(F.char_length(text)).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    some = rows.filter(F.char_length(text) > 0).withColumn("_behind", from_the_end(key, "session", "_chunk")).filter(
        F.col("_behind") < keep)
    ends = some.withColumn("_behind", from_the_end(key, "session")).filter(F.col("_behind") < keep)
    texts = ends.groupBy(key, "session").agg(
        F.array_sort(F.collect_list(F.struct("_t", tie, F.col(text).alias("s")))).alias("_parts")).select(
        key, "session", F.expr(f"right(array_join(_parts.s, ''), {keep})").alias("text"))
    return same_key(counts, texts, [key, "session"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def allow_window(messages: DataFrame, allows: DataFrame, key: str, ts: str, ttl_seconds: int = 600) -> DataFrame:
    """Messages not preceded, within the time to live, by an allow of the same key.

    Time is cut into buckets as long as the time to live. An allow in a message's own bucket
    covers it when it is not later; one in the bucket before covers it when it is late enough. So
    the earliest and the latest allow per (key, bucket) decide, and each message meets at most
    two rows whatever the number of allows.
    """
    ttl = ttl_seconds * SECOND
    per = (allows.select(key, micros(ts).alias("_a")).withColumn("_bucket", F.floor(F.col("_a") / ttl))
           .groupBy(key, "_bucket").agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi")))
    own = per.select(key, "_bucket", "_lo", F.lit(None).cast("bigint").alias("_hi"))
    next_ = per.select(key, (F.col("_bucket") + 1).alias("_bucket"), F.lit(None).cast("bigint").alias("_lo"), "_hi")
    cover = own.unionByName(next_).groupBy(key, "_bucket").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    rows = messages.withColumn("_t", micros(ts)).withColumn("_bucket", F.floor(F.col("_t") / ttl))
    joined = rows.join(cover, [key, "_bucket"], "left")
    return joined.filter(f"NOT coalesce(_t >= _lo, false) AND NOT coalesce(_t <= _hi + {ttl}, false)").drop(
        "_t", "_bucket", "_lo", "_hi")


def tail_covers(a: DataFrame, b: DataFrame, key: str, typed: str, field: str) -> DataFrame:
    """Per session, whether the last 12 non-space characters typed occur in the field.

    Fewer than three such characters always agree.
    """
    def bare(column: str) -> Column:
        return F.regexp_replace(F.lower(F.col(column)), r"\s", "")

    both = a.join(b, key).withColumn("_tail", F.right(bare(typed), F.lit(12)))
    return both.withColumn("covers", (F.char_length("_tail") < 3) | F.contains(bare(field), F.col("_tail"))).drop("_tail")


def top_events(df: DataFrame, n: int, ts: str = "occurred_at", tie: str = "event_id") -> DataFrame:
    """O2: the newest n events; each task keeps its own n, only those are merged."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def budgeted_batch(df: DataFrame, batch: str, order: str, n: int = 80) -> DataFrame:
    """O3: the first n fresh texts of each pass are judged, the rest wait: ``deferred``.

    The n-th position of every pass comes from a two-step ranking; rows are then compared
    with it, so a pass of any size is never ranked in one task. ``order`` is unique in a pass.
    """
    first = newest(df.select(batch, (-F.col(order)).alias("_back")), batch, "_back", n)
    limit = first.groupBy(batch).agg(F.max(-F.col("_back")).alias("_limit"))
    return same_key(df, limit, [batch]).withColumn("deferred", F.col(order) > F.col("_limit")).drop("_limit")
