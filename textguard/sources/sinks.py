"""Writers (K1-K5, K7, K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.operators.context import newest
from textguard.functions.arrays import quote

# How an event is worded in a report.
KIND_LABELS = {
    "caught": "Caught", "covered": "Covered", "rephrased": "Rephrased", "sent_anyway": "Sent anyway", "edited": "Edited", "deleted": "Deleted",
    "resources": "Showed resources",
}


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of every key; a map-side aggregation, so a hot key sends one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("b"))  # equal stamps: by the other columns
    return best.select(*keys, "b.*").select(*df.columns)


def merge_daily_stats(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """K1: upsert on (install_id, day), the last write wins."""
    return latest(stored.unionByName(incoming), ["install_id", "day"], "updated_at")


def merge_installs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """K3: upsert on install_id: newest settings, first ``created_at``, last ``last_seen_at``."""
    rows = stored.unionByName(incoming)
    rest = [c for c in rows.columns if c not in ("install_id", "created_at", "last_seen_at")]
    best = rows.groupBy("install_id").agg(
        F.max_by(F.struct(*rest), F.struct("last_seen_at", *rest)).alias("b"),
        F.min("created_at").alias("created_at"), F.max("last_seen_at").alias("last_seen_at"))
    return best.select("install_id", "b.*", "created_at", "last_seen_at").select(*rows.columns)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except Exception as problem:  # an absent or empty folder has no schema
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return False
        raise


def sink_daily_stats(df: DataFrame, path: str) -> None:
    """K1 as a table in a folder: only the days that arrive are rewritten."""
    spark = df.sparkSession
    if exists(spark, path):
        days = F.broadcast(df.select("day").distinct())  # at most one row per calendar day
        stored = spark.read.parquet(path).join(days, "day", "left_semi").select(*df.columns)
        df = merge_daily_stats(stored, df)
    else:
        df = latest(df, ["install_id", "day"], "updated_at")
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def event_rows(df: DataFrame) -> DataFrame:
    """K2: events as stored: the score clamped to 0..1, with the day they belong to."""
    return df.withColumn("score", F.expr("least(greatest(score, 0e0), 1e0)")).withColumn("day", F.to_date("occurred_at"))


def sink_events(df: DataFrame, path: str) -> None:
    """K2: append, partitioned by day."""
    event_rows(df).write.mode("append").partitionBy("day").parquet(path)


def sink_installs(df: DataFrame, path: str, version: str) -> DataFrame:
    """K3: the next version of the installs table, written beside the one it was made from."""
    spark = df.sparkSession
    merged = merge_installs(spark.read.parquet(path), df) if exists(spark, path) else latest(df, ["install_id"], "last_seen_at")
    merged.write.mode("overwrite").parquet(version)
    return spark.read.parquet(version)


def report_entry() -> str:
    """One event as Markdown; lines that have nothing to say are left out."""
    label = "CASE kind " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in KIND_LABELS.items()) + " ELSE kind END"
    severity = "CASE WHEN score < 0.55e0 THEN 'Sharp' WHEN score < 0.78e0 THEN 'Harsh' ELSE 'Cruel' END"
    return f"""concat_ws('\\n',
        concat('### ', date_format(occurred_at, 'yyyy-MM-dd HH:mm')),
        '',
        concat('- **What happened:** ', {label}),
        if(score > 0, concat('- **Severity:** ', {severity}, ' (', cast(cast(floor(score * 100) AS int) AS string), '%)'), null),
        if(app IS NOT NULL, concat('- **Where:** ', app), null),
        if(reason != '', concat('- **Why it was flagged:** ', reason), null),
        if(kind != 'resources' AND text IS NOT NULL, concat('- **Message:** ', text), null),
        if(rewritten != '', concat('- **Rewritten to:** ', rewritten), null),
        '')"""


def report_entries(events: DataFrame, key: str = "install_id", tie: str = "event_id") -> DataFrame:
    """K4, the lines: one row per event with its Markdown and a sort position, newest first."""
    return events.select(key, F.expr("-unix_micros(cast(occurred_at AS timestamp))").alias("place"), tie, F.expr(report_entry()).alias("entry"))


def newest_report(events: DataFrame, limit: int, key: str = "install_id", tie: str = "event_id") -> DataFrame:
    """K4, a short form on request: the newest ``limit`` events of each key as one text: (key, entries, body).

    The whole record is :func:`report_entries` and :func:`write_report`, which never put a key into one row.
    """
    shown = newest(events.withColumn("_t", F.unix_micros(F.col("occurred_at").cast("timestamp"))), key, "_t", limit, tie)
    lines = shown.select(key, "rank", F.expr(report_entry()).alias("entry"))
    return (lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("es"))
            .select(key, F.size("es").alias("entries"), F.expr("array_join(es.entry, '\n')").alias("body")))


def write_report(events: DataFrame, path: str, key: str = "install_id", tie: str = "event_id") -> None:
    """K4 in full: text files per key, entries in order; long histories span several files."""
    lines = report_entries(events, key, tie)
    spread = lines.repartitionByRange(F.col(key), F.col("place")).sortWithinPartitions(key, "place", tie)
    spread.select(key, F.col("entry").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def review_prompt(context: str, text: str, lines: int = 12, width: int = 400, chars: int = 2000) -> str:
    """The reviewer's prompt: the last context lines, oldest first, then the draft."""
    shown = f"slice({context}, greatest(size({context}) - {lines - 1}, 1), {lines})"
    body = f"array_join(transform({shown}, l -> concat('- ', left(l, {width}), '\\n')), '')"
    return (f"concat(CASE WHEN size({context}) > 0 THEN concat('CONVERSATION (oldest first):\\n', {body}, '\\n')"
            f" ELSE 'CONVERSATION: (none available)\\n\\n' END,"
            f" 'DRAFT the writer is about to send:\\n', left({text}, {chars}))")


def review_requests(df: DataFrame, key: str, context: str = "context", text: str = "text") -> DataFrame:
    """K5: one JSON line per message that goes to the reviewer."""
    return df.select(key, F.expr(review_prompt(context, text)).alias("prompt")).select(
        key, "prompt", F.to_json(F.struct(F.col(key).alias("id"), "prompt")).alias("json"))


def write_review_requests(df: DataFrame, path: str, key: str, context: str = "context", text: str = "text") -> None:
    """K5 as JSON-lines files."""
    review_requests(df, key, context, text).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_train_json(df: DataFrame, path: str, seed: int = 7) -> DataFrame:
    """K7: rows in a repeatable random order as JSON lines; returns the label counts."""
    from textguard.plans.corpus import draw
    shuffled = df.withColumn("_draw", draw("text", seed)).orderBy("_draw", "text").drop("_draw")
    shuffled.write.mode("overwrite").json(path)
    return df.groupBy("label").agg(F.count("*").alias("n"))


def telemetry_snapshot(df: DataFrame, path: str) -> None:
    """K8: the day's counters, one folder per day."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def reload_snapshot(df: DataFrame, as_of: str) -> DataFrame:
    """K8: only today's counters are taken up again; ``as_of`` is an SQL date expression."""
    return df.filter(f"day = {as_of}")
