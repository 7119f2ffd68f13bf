"""J10 over runs: verdicts that outlive the job that made them.

A verdict belongs to a text in its context: the key covers both. A run looks its keys up in the store, scores the keys nobody has scored
yet, each once, and appends them as the run's version. Verdicts that still wait for a reviewer are not stored, so a later run
takes them up again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.arrays import mapping, same_key
from textguard.operators.normalize import normalize
from textguard.sources.sinks import exists

#: So many lines of context are part of a key.
LINES = 12
VARIANTS = ("exact", "trimmed", "squashed")


def verdict_key(text: str = "text", context: str | None = "context") -> Column:
    """The key of a text and the last twelve lines before it. Parts are told apart by their lengths, so no two pairs share a key by being joined alike."""
    parts = f"array(coalesce({text}, ''))" if context is None else f"concat(array(coalesce({text}, '')), slice(coalesce({context}, array()), greatest(size(coalesce({context}, array())) - {LINES - 1}, 1), {LINES}))"
    return F.sha2(F.expr(f"array_join(transform({parts}, p -> concat(char_length(coalesce(p, '')), ':', coalesce(p, ''))), '')"), 256)


def with_key(df: DataFrame, text: str = "text", context: str | None = "context", variant: str = "exact", out: str = "verdict_key") -> DataFrame:
    """Adds the key. ``trimmed`` leaves out white space at both ends of the text, ``squashed`` goes by its letters as the normaliser leaves them:
    one verdict then serves all spellings, so only a score that does not look at the spelling may be kept under it."""
    if variant not in VARIANTS:
        raise ValueError(f"variant is one of {', '.join(VARIANTS)}")
    if variant == "exact":
        return df.withColumn(out, verdict_key(text, context))
    if variant == "trimmed":
        return df.withColumn("_bare", F.regexp_replace(text, r"^\s+|\s+$", "")).withColumn(out, verdict_key("_bare", context)).drop("_bare")
    kept = df.columns
    return normalize(df, text, keep=["squashed"]).withColumn(out, verdict_key("squashed", context)).select(*kept, out)


def read_store(df: DataFrame, path: str, columns: list[str], before: int | None = None) -> DataFrame | None:
    """The newest verdict of each key, or nothing where there is no store yet; ``before`` leaves out that version and later ones."""
    spark = df.sparkSession
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.filter(F.col("version") < before)
    return rows.groupBy("verdict_key").agg(F.max_by(F.struct(*columns), "version").alias("_v")).select("verdict_key", "_v.*")


def cached(df: DataFrame, path: str, version: int, score_fn: Callable[[DataFrame], DataFrame], verdict: list[str], row_id: str, key: str = "verdict_key",
           keep: list[str] | None = None, salts: int = 32) -> DataFrame:
    """Every row with the verdict of its key, and ``from_store``: whether an earlier version had it.

    ``score_fn`` gets one row for each key without a verdict (the key and ``keep``, by default all other columns, of the row that sorts first) and returns the
    key with the columns ``verdict``; where these hold ``pending``, pending verdicts are returned but not stored. ``version`` numbers the
    runs. Running a version again rewrites it from what was stored before it, so a run that was lost half-way does no harm.

    A hot key's rows are spread over (key, salt) for the way back, as in :func:`textguard.operators.cascade.cached_verdict`.
    """
    keep = keep or [c for c in df.columns if c != key]
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    pairs = rows.groupBy(key, "_salt").agg(F.min(F.struct(*keep)).alias("_first"))
    keys = pairs.groupBy(key).agg(F.min("_first").alias("_first"))
    stored = read_store(df, path, verdict, version)
    unseen = keys if stored is None else keys.join(stored.select(F.col("verdict_key").alias(key)), key, "left_anti")
    fresh = score_fn(unseen.select(key, "_first.*")).select(F.col(key).alias("verdict_key"), *verdict, F.lit(version).cast("bigint").alias("version"))
    # Written first and read back: what is stored is what is returned, and nothing is scored twice.
    waiting = "coalesce(pending, false)" if "pending" in verdict else "false"
    fresh.withColumn("settled", F.expr(f"NOT {waiting}")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("settled", "version").parquet(f"{path}_runs")
    spark, schema = df.sparkSession, fresh.withColumn("settled", F.lit(True)).schema
    made = spark.read.schema(schema).parquet(f"{path}_runs").filter(F.col("version") == version)
    made.filter("settled").drop("settled").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)
    found = made.select("verdict_key", *verdict, F.lit(False).alias("from_store"))
    if stored is not None:
        found = found.unionByName(stored.join(keys.select(F.col(key).alias("verdict_key")), "verdict_key", "left_semi").select("verdict_key", *verdict, F.lit(True).alias("from_store")))
    verdicts = same_key(pairs.select(key, "_salt"), found.withColumnRenamed("verdict_key", key), [key])
    return same_key(rows, verdicts, [key, "_salt"]).drop("_salt")


#: How a tier is called in a source.
SHORT = {"cache": "CACHE", "rules": "T0", "on_device": "T1", "context": "T2"}


def cached_source(tier: str = "tier", from_store: str = "from_store", source: str = "source") -> Column:
    """Who decided a message: 'cached' and the tier that once did, or the source of a verdict made now."""
    return F.expr(f"if({from_store}, concat('cached ', element_at({mapping(SHORT)}, {tier})), {source})")
