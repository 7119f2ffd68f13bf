"""Headline queries at one scale, timed; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["normalize", "lexical_fallback_score", "tier0_documents", "tier0_verdict", "local_verdict", "hold_policy", "cached_verdict",
            "doc_toxicity_eval", "context_window", "pile_on", "daily_totals", "install_overview", "severity_mix", "daily_stats_build",
            "typing_sessions", "running_quota", "allow_window", "rate_limit", "latency_percentiles", "exact_dedupe", "clean_corpus"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("textguard-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "10g").config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from textguard.queries import QUERIES

    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "documents_per_second_tier0": round(docs / times["tier0_documents"], 1),
        "tier0_ms_per_document_and_core": round(1000 * times["tier0_documents"] * int(cpus) / docs, 3),
    }))


if __name__ == "__main__":
    main()
