"""Readers (S1-S4, S6, K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.functions.arrays import words
from textguard.operators.policy import CATEGORY_ORDER
from textguard.operators.tier0 import level_of

FIXTURES = "version INT, cases ARRAY<STRUCT<id STRING, title STRING, note STRING, expect STRING, context ARRAY<STRING>, draft STRING>>"
CURATED = "rows ARRAY<STRUCT<text STRING, label STRING>>"
MESSAGES = "msg_id BIGINT, conv_id BIGINT, turn BIGINT, sender STRING, app_id STRING, ts TIMESTAMP, text STRING"
REVIEW = "score DOUBLE, confidence DOUBLE, categories ARRAY<STRING>, rationale STRING, self_directed_distress BOOLEAN"


def read_label_csv(spark: SparkSession, path: str, text: str, label: str, text_at: int | None = None,
                   label_at: int | None = None) -> DataFrame:
    """Labelled CSV. Quoted fields may hold commas, doubled quotes and line breaks. Columns go
    by header name, or by position where the name is missing; rows too short for them are dropped.
    """
    raw = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
           .option("mode", "PERMISSIVE").csv(path))
    text_col = text if text in raw.columns else raw.columns[text_at]
    label_col = label if label in raw.columns else raw.columns[label_at]
    return raw.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label")).filter(
        F.col("text").isNotNull() & F.col("label").isNotNull())


def read_fixtures(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per case of a fixture file. With ``lines`` a file holds one object per line, and can be split."""
    return spark.read.schema(FIXTURES).option("multiLine", not lines).json(path).select(F.explode("cases").alias("c")).select("c.*")


def read_curated(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """S3: one row per curated text; ``lines`` as for fixtures."""
    return spark.read.schema(CURATED).option("multiLine", not lines).json(path).select(F.explode("rows").alias("r")).select("r.*")


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """One term per line with its line number, from zero; empty lines count but have no row.

    Files may be large and many: they follow each other by name, and are read in splits. A line's number is its place in its split, and the
    lines of the splits and files before it, which are one count a split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", r"\r$", "").alias("term"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    placed = lines.withColumn("_place", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = placed.join(splits.drop("_n"), ["_file", "_block"])
    return found.select("term", (F.col("_before") + F.col("_place") - 1).cast("bigint").alias("id")).filter(F.col("term") != "")


def message_stream(spark: SparkSession, path: str, schema: str | T.StructType = MESSAGES, fmt: str = "parquet",
                   files_per_trigger: int = 100) -> DataFrame:
    """An unbounded feed of messages from files that keep arriving in a folder."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def parse_review(df: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """Reviewer JSON parsed and checked; ``valid`` is false where it cannot be used."""
    kept = words([c for c in CATEGORY_ORDER])
    parsed = df.withColumn("v", F.from_json(raw, REVIEW))
    complete = "v IS NOT NULL AND " + " AND ".join(
        f"v.{c} IS NOT NULL" for c in ("score", "confidence", "categories", "rationale", "self_directed_distress"))
    score = "if(v.self_directed_distress, 0e0, least(greatest(v.score, 0e0), 1e0))"
    return parsed.withColumn("valid", F.expr(complete)).select(
        key, raw, "valid", F.expr(score).alias("r_score"),
        F.expr("least(greatest(v.confidence, 0e0), 1e0)").alias("r_confidence"),
        F.expr(f"filter(v.categories, c -> array_contains({kept}, c))").alias("r_categories"),
        F.expr("trim(v.rationale)").alias("r_rationale"),
        F.expr("v.self_directed_distress").alias("r_self_directed"),
        F.expr(level_of(score)).alias("r_level"))


def review_verdicts(df: DataFrame, key: str, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """K6: (usable reviewer verdicts, quarantined raw rows). Scores are clamped, unknown
    categories dropped, and the writer's own distress scores zero."""
    parsed = parse_review(df, key, raw)
    return parsed.filter("valid").drop("valid", raw), parsed.filter("NOT valid").select(key, raw)
