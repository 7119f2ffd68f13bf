"""Roll-ups of events and traces.

Every group-by here aggregates on the map side first, so a hot install or day costs one partial
row per task. Nothing collects a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions.arrays import same_key
from textguard.operators.context import newest

COUNTERS = ["caught", "rewritten", "dropped", "sent_anyway", "covered", "tier_rules", "tier_device", "tier_context"]
TIER_IDS = {"cache": -1, "rules": 0, "on_device": 1, "context": 2}


def daily_totals(daily: DataFrame) -> DataFrame:
    """A1: per day, newest first; the percentage is null when nothing was caught."""
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    share = "round(100.0e0 * (rewritten + dropped) / nullif(caught, 0), 1)"
    return (daily.groupBy("day").agg(F.count("*").alias("installs"), *sums)
            .withColumn("pct_reconsidered", F.expr(share)).orderBy(F.col("day").desc()))


def install_overview(installs: DataFrame, events: DataFrame) -> DataFrame:
    """One row per install, with or without events.

    Events are rolled up per install before the join, so the join sees one row per install.
    """
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("caught", "rephrased", "covered", "sent_anyway")]
    mean = F.avg(F.when(F.col("kind").isin("caught", "covered"), F.col("score")))
    per = events.groupBy("install_id").agg(*counts, F.round(mean, 2).alias("avg_severity"))
    zero = [F.coalesce(k, F.lit(0)).alias(k) for k in ("caught", "rephrased", "covered", "sent_anyway")]
    return installs.join(per, "install_id", "left").select(
        "install_id", "sensitivity", "outgoing_on", "incoming_on",
        F.col("passcode_digest").isNotNull().alias("passcode_set"), "created_at", "last_seen_at", *zero, "avg_severity")


def severity_mix(events: DataFrame) -> DataFrame:
    """A3: day x severity, newest day first."""
    return (events.filter("severity IS NOT NULL").groupBy(F.to_date("occurred_at").alias("day"), "severity")
            .agg(F.count("*").alias("events")).orderBy(F.col("day").desc(), "severity"))


def tier_telemetry(traces: DataFrame) -> DataFrame:
    """A4: per day and tier: analyses, latency, share of the day, escalations."""
    per = traces.groupBy("day", "tier").agg(
        F.count("*").alias("n"), F.sum("latency_ms").alias("latency_sum"), F.avg("latency_ms").alias("latency_avg"),
        F.count(F.when(F.col("escalated"), 1)).alias("escalated"))
    day = Window.partitionBy("day")  # at most four rows per day by now
    return per.withColumns({
        "share": F.col("n") / F.sum("n").over(day),
        "day_escalated_pct": F.expr("cast(100 * sum(escalated) OVER (PARTITION BY day) div sum(n) OVER (PARTITION BY day) AS int)"),
    })


def outcome_counters(events: DataFrame) -> DataFrame:
    """A5: per day: held, sent anyway, edited, deleted, covered."""
    names = {"holds": "caught", "sent_anyway": "sent_anyway", "edited": "rephrased", "deleted": "deleted", "covered": "covered"}
    return events.groupBy(F.to_date("occurred_at").alias("day")).agg(
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(name) for name, kind in names.items()])


def daily_stats_build(events: DataFrame, traces: DataFrame) -> DataFrame:
    """One row per (install, day) from events and traces.

    The two inputs are brought to one shape and aggregated together: one shuffle instead of two
    plus a full outer join.
    """
    kinds = {"caught": "caught", "rewritten": "rephrased", "dropped": "deleted", "sent_anyway": "sent_anyway",
             "covered": "covered"}
    tiers = {"tier_rules": "rules", "tier_device": "on_device", "tier_context": "context"}
    rows = events.select("install_id", F.to_date("occurred_at").alias("day"), "kind", F.lit(None).cast("string").alias("tier"),
                         "occurred_at").unionByName(
        traces.select("install_id", F.to_date("occurred_at").alias("day"), F.lit(None).cast("string").alias("kind"), "tier",
                      "occurred_at"))
    return rows.groupBy("install_id", "day").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(name) for name, k in kinds.items()],
        *[F.count(F.when(F.col("tier") == t, 1)).alias(name) for name, t in tiers.items()],
        F.max("occurred_at").alias("updated_at"))


def latency_percentiles(df: DataFrame, by: str, value: str = "latency_ms", median_limit: float | None = None,
                        p95_limit: float | None = None, bins: int = 256) -> DataFrame:
    """Exact index picks, sorted[n div 2] and sorted[int(0.95 n)], per scorer.

    Ranks come from a histogram: values are counted per bin, the bin that holds the wanted rank
    is found among the bins, and only that bin's values are ranked. Equal values are counted,
    not listed, and the bins' edges are approximate quantiles of each scorer, so no bin holds much
    more than its share of the rest.
    """
    bins = max(bins, 2)  # one bin has no edge to tell it by
    edges = df.groupBy(by).agg(F.percentile_approx(value, [k / bins for k in range(1, bins)]).alias("_edges"))
    counted = same_key(df.groupBy(by, value).agg(F.count("*").alias("n")), edges, [by])
    counted = counted.withColumn("bin", F.size(F.filter("_edges", lambda e: e <= F.col(value)))).drop("_edges")
    totals = counted.groupBy(by, "bin").agg(F.sum("n").alias("bin_n"))
    order = Window.partitionBy(by).orderBy("bin")
    totals = totals.withColumns({
        "upto": F.sum("bin_n").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("bin_n").over(Window.partitionBy(by)),
    })
    wanted = totals.select(by, "bin", "bin_n", "upto", "total", F.explode(F.expr(
        "array(struct('median' AS name, total div 2 AS pick), struct('p95' AS name, cast(floor(0.95e0 * total) AS bigint) AS pick))"
    )).alias("w")).select("*", "w.*").drop("w").filter("pick >= upto - bin_n AND pick < upto")
    inside = Window.partitionBy(by, "bin", "name").orderBy(value)
    ranked = counted.join(wanted, [by, "bin"]).withColumn(
        "seen", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("upto") - F.col("bin_n"))
    picks = ranked.filter("pick < seen AND pick >= seen - n")
    out = picks.groupBy(by).agg(
        F.max("total").alias("n"),
        F.max(F.when(F.col("name") == "median", F.col(value))).alias("median"),
        F.max(F.when(F.col("name") == "p95", F.col(value))).alias("p95"))
    if median_limit is not None:
        out = out.withColumn("within_limits", F.expr(f"median < {median_limit} AND p95 < {p95_limit}"))
    return out


def worst_examples(df: DataFrame, group: str, order: str, text: str, n: int = 5) -> DataFrame:
    """The first n failures of each group, joined by ' | '."""
    first = newest(df.withColumn("_back", -F.col(order)), group, "_back", n)
    return first.groupBy(group).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t")))), lambda s: s["t"]), " | ").alias("worst"))


def conversation_summary(verdicts: DataFrame, key: str = "conv_id", sender: str = "role") -> DataFrame:
    """Per conversation and sender: messages, held, covered, highest score, categories.

    There are eleven categories, so the collected set of combinations is bounded.
    """
    return verdicts.groupBy(key, sender).agg(
        F.count("*").alias("messages"), F.count_if("held").alias("held"), F.count_if("covered").alias("covered"),
        F.max("score").alias("max_score"),
        F.expr("array_join(array_sort(array_distinct(flatten(collect_set(categories)))), ',')").alias("categories"))


def category_mix(verdicts: DataFrame, *by: str) -> DataFrame:
    """A10: how often each category occurs."""
    return verdicts.select(*by, F.explode("categories").alias("category")).groupBy(*by, "category").agg(
        F.count("*").alias("n"))
