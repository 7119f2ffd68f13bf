"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """UTC timestamps, dynamic partition overwrite, adaptive plans, and a checkpoint folder.

    The cluster names the folder in ``spark.checkpoint.dir``. Only where that is unset (local
    runs and tests) a temporary one is made.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Scoring is heavy per row: small shuffles keep a partition per core instead of one in all.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and streaming state."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="textguard-")
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
