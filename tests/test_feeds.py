"""Streams against their batch forms: traces, allows, sessions, daily counters, late rows; and the verdict store."""
import random

import pytest
from pyspark.sql import functions as F

from textguard.operators import cascade, normalize, tier0
from textguard.operators import verdict_store as V
from textguard.plans import activity as A
from textguard.plans import rollups, traces
from textguard.queries import catalog_corpus as C
from textguard.sources import readers
from textguard.streaming import streams


def shuffled(df, ts="ts", files=5):
    """Files whose rows are in no order of time within a slice."""
    return df.repartition(files, F.hash(ts))


def test_allows_over_two_streams_match_the_batch_form(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(40_000) * 1000) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    messages, allows = shuffled(df.where("id % 4 != 0")), shuffled(df.where("id % 4 = 0 AND k IS NOT NULL").select("k", "ts"))
    got = C.replayed(spark, [messages, allows], "ts", lambda m, a: streams.allow_ttl(m, a, "k", delay="1 minute"), ahead={"k": "nobody"})
    want = A.allow_window(messages, allows, "k", "ts")
    kept = sorted(r.id for r in got.where("id IS NOT NULL").collect())
    assert kept == sorted(r.id for r in want.collect()) and 0 < len(kept) < messages.count()


def test_an_allow_lasts_to_its_last_microsecond(spark):
    m = spark.createDataFrame([(i, "k", 10_000_000_000 + d) for i, d in enumerate([-1, 0, 599_999_999, 600_000_000, 600_000_001])], "id long, k string, us long").selectExpr("id", "k", "timestamp_micros(us) AS ts")
    a = spark.createDataFrame([("k", 10_000_000_000)], "k string, us long").selectExpr("k", "timestamp_micros(us) AS ts")
    got = C.replayed(spark, [m, a], "ts", lambda x, y: streams.allow_ttl(x, y, "k", delay="20 minutes"), slices=1, ahead={"k": "nobody"})
    assert sorted(r.id for r in got.where("id IS NOT NULL").collect()) == [0, 4] == sorted(r.id for r in A.allow_window(m, a, "k", "ts").collect())


def test_sessions_close_and_the_open_ones_are_named(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice("xy"), 1_700_000_000 + rng.randrange(20_000)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, app string, s long").selectExpr("k", "app", "timestamp_seconds(s) AS ts")
    for low, high in ((0, 10_000), (10_000, 20_000)):
        part = df.where(f"unix_seconds(ts) - 1700000000 >= {low} AND unix_seconds(ts) - 1700000000 < {high}")
        shuffled(part).write.mode("append").parquet(str(tmp_path / "in"))
        query = (streams.stream_sessions(readers.message_stream(spark, str(tmp_path / "in"), df.schema), "k", "app").writeStream.format("parquet")
                 .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        query.awaitTermination()
    mark = df.selectExpr("max(ts) - INTERVAL 10 MINUTES AS m").first().m
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    still = {tuple(r) for r in streams.open_sessions(df, "k", "app", f"timestamp'{mark}'").collect()}
    every = {tuple(r) for r in streams.open_sessions(df, "k", "app", "timestamp'1970-01-01'").collect()}
    assert closed | still == every and not closed & still and closed and still


def counters(spark, path):
    return sorted((tuple(r) for r in streams.daily_rollup_table(spark, path).select("install_id", "day", *rollups.COUNTERS).collect()), key=repr)


def test_daily_counters_survive_replays_and_skip_what_is_unchanged(spark, tmp_path):
    rng = random.Random(3)
    kinds, tiers = [*streams.OUTCOMES.values(), "resources"], ["rules", "on_device", "context", "cache"]
    rows = [(rng.choice(["a", "b", None]), rng.choice(kinds) if i % 2 else None, None if i % 2 else rng.choice(tiers), 1_700_000_000 + rng.randrange(150_000)) for i in range(300)]  # within the delay of two days
    df = spark.createDataFrame(rows, "install_id string, kind string, tier string, s long").selectExpr("install_id", "kind", "tier", "timestamp_seconds(s) AS occurred_at")
    table, state, source = (str(tmp_path / n) for n in ("table", "state", "in"))

    def run():
        q = streams.push_daily_rollup(readers.message_stream(spark, source, df.schema), table, state, availableNow=True)
        q.awaitTermination()
        return q

    batches = []
    for part in (df.where("unix_seconds(occurred_at) % 2 = 0"), df.where("unix_seconds(occurred_at) % 2 = 1"), df.where("kind = 'resources'").limit(2)):
        part.write.mode("append").parquet(source)
        run()
        batches.append(spark.read.parquet(table).groupBy("batch_id").count().collect())
    whole = df.unionByName(df.where("kind = 'resources'").limit(2))
    want = rollups.daily_stats_build(whole.where("kind IS NOT NULL"), whole.where("tier IS NOT NULL"))
    assert counters(spark, table) == sorted((tuple(r) for r in want.select("install_id", "day", *rollups.COUNTERS).collect()), key=repr)
    # Events that no counter counts change no counter, so nothing was written for the last batch.
    assert sorted(batches[2]) == sorted(batches[1])
    # A batch that is run again leaves the table as it is, whether it had been written whole, in part, or not at all.
    last = max(r.batch_id for r in batches[2])
    before = sorted(map(str, spark.read.parquet(table).collect()))
    again = spark.read.parquet(table).where(f"batch_id = {last}").drop("batch_id", "digest")
    again = spark.createDataFrame(again.collect(), again.schema)
    streams.push_snapshot(again, last, table)
    assert sorted(map(str, spark.read.parquet(table).collect())) == before
    lost = spark.createDataFrame([], again.schema)
    streams.push_snapshot(lost, last + 1, table)
    assert sorted(map(str, spark.read.parquet(table).collect())) == before


@pytest.mark.parametrize("limit, received", [("1 DAY", None), ("2 DAY", None), ("2 DAY", "received_at")])
def test_late_rows_land_in_quarantine(spark, tmp_path, limit, received):
    rng, day = random.Random(4), 86_400
    batches = [[(10 * b + i, 1_700_000_000 + day * (b - rng.choice([0, 0, 0.9, 1.5, 3]))) for i in range(10)] for b in range(4)]
    rows = [(i, int(s)) for b in batches for i, s in b]
    df = spark.createDataFrame(rows, "id long, s long").selectExpr("id", "if(id = 13, null, timestamp_seconds(s)) AS ts", "timestamp_seconds(1700000000 + (id div 10) * 86400) AS received_at")
    folder = str(tmp_path / "late")
    for b in range(4):
        df.where(f"id div 10 = {b}").write.mode("append").parquet(str(tmp_path / "in"))
        streams.push_late_split(readers.message_stream(spark, str(tmp_path / "in"), df.schema), folder, str(tmp_path / "state"), ts="ts", limit=limit, received=received, availableNow=True).awaitTermination()
    span, times, want, seen = int(limit[0]) * day, {i: None if i == 13 else s for i, s in rows}, [], []
    for b in range(4):
        mark = 1_700_000_000 + b * day - span if received else max(seen) - span if seen else None
        want += [i for i in range(10 * b, 10 * b + 10) if times[i] is None or mark is not None and times[i] <= mark]
        seen += [times[i] for i in range(10 * b, 10 * b + 10) if times[i] is not None]

    def tables():
        return [sorted((r.id, r.batch_id) for r in spark.read.parquet(f"{folder}/{n}").collect()) for n in ("accepted", "quarantine")]

    accepted, late = tables()
    assert [i for i, _ in late] == want and sorted(i for i, _ in accepted + late) == [i for i, _ in rows] and len(want) > 3
    ledger = spark.read.parquet(f"{folder}/ledger").orderBy("batch_id").collect()
    assert sum(r.late for r in ledger) == len(want) and sum(r.accepted for r in ledger) == 40 - len(want)
    # The last batch once more: nothing changes.
    streams.split_late(df.where("id div 10 = 3"), ledger[-1].batch_id, "ts", limit, *[f"{folder}/{n}" for n in ("accepted", "quarantine", "ledger")], received)
    assert tables() == [accepted, late] and spark.read.parquet(f"{folder}/ledger").orderBy("batch_id").collect() == ledger


def verdicts(spark):
    lines = ["you are such an idiot", "i want to die", "see you at practice", "you suck", "kys", "x", "", None, "you look a little tired " * 20]
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(lines * 3)], "msg_id long, text string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("msg_id") * 20_000))
    local = cascade.local_verdict(tier0.tier0_verdict(raw, keep=["msg_id", "ts", "text"])).withColumn("latency_ms", F.col("msg_id") + 1e0)
    review = raw.select("msg_id", F.lit(0.4).alias("r_score"), F.lit(0.5).alias("r_confidence"), F.array(F.lit("insult")).alias("r_categories"), F.lit("why").alias("r_rationale"),
                        F.lit(False).alias("r_self_directed"), F.lit(400.0).alias("r_latency_ms"))
    return traces.trace_rows(cascade.cascade_route(local, review, "msg_id"), "msg_id", "ts")


def by_tier(df):
    per = rollups.tier_telemetry(df).groupBy("tier").agg(F.sum("n").alias("n"), F.sum("latency_sum").alias("latency_sum"), F.sum("escalated").alias("escalated"))
    return sorted((r.tier, r.n, round(r.latency_sum, 6), r.escalated) for r in per.collect())


def test_observed_traces_match_the_roll_up(spark, tmp_path):
    rows = verdicts(spark)
    found = traces.write_traces(rows, str(tmp_path / "traces"))
    table = spark.read.parquet(str(tmp_path / "traces"))
    assert sorted((r.tier, r.n, round(r.latency_sum, 6), r.escalated) for r in found.collect()) == by_tier(table) and table.count() == 27
    assert max(len(r.snippet or "") for r in table.collect()) == 140 and {r.source for r in table.collect() if r.escalated} <= {"T2 reviewer"}
    assert abs(sum(r.share for r in found.collect()) - 1) < 1e-9
    nothing = traces.write_traces(rows.limit(0), str(tmp_path / "none"))
    assert nothing.collect() == []


def test_streamed_traces_match_the_roll_up(spark, tmp_path):
    rows = spark.createDataFrame(verdicts(spark).collect(), verdicts(spark).schema)
    totals = traces.Totals()
    spark.streams.addListener(totals)
    try:
        for part in (rows.where("msg_id % 2 = 0"), rows.where("msg_id % 2 = 1")):
            part.write.mode("append").parquet(str(tmp_path / "in"))
            stream = readers.message_stream(spark, str(tmp_path / "in"), rows.schema)
            traces.stream_traces(stream, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
            assert totals.ended.wait(60)
    finally:
        spark.streams.removeListener(totals)
    found = traces.telemetry(spark, totals.sums)
    assert sorted((r.tier, r.n, round(r.latency_sum, 6), r.escalated) for r in found.collect()) == by_tier(spark.read.parquet(str(tmp_path / "out")))


# ------------------------------------------------------------------ verdict store
def test_keys_tell_texts_and_contexts_apart(spark):
    rows = [("a", []), ("a", None), ("a", ["b"]), ("b", ["a"]), ("ab", []), ("a", ["b", "c"]), ("a", ["bc"]), ("a", ["b1:c"]), ("a", [str(i) for i in range(13)]), ("a", [str(i) for i in range(1, 13)]), (None, []), ("", [])]
    got = [r.k for r in spark.createDataFrame(rows, "text string, context array<string>").select(V.verdict_key().alias("k")).collect()]
    same = {(0, 1), (8, 9), (10, 11)}
    for i in range(len(rows)):
        for j in range(i):
            assert (got[i] == got[j]) == ((j, i) in same), (rows[i], rows[j])


@pytest.mark.parametrize("variant, equal", [("exact", 0), ("trimmed", 1), ("squashed", 2)])
def test_variants_of_the_key(spark, variant, equal):
    df = spark.createDataFrame([(0, "you idiot"), (1, "  you idiot\n"), (2, "y o u  idiot")], "id long, text string")
    keys = {r.id: r.verdict_key for r in V.with_key(df, context=None, variant=variant).collect()}
    assert (keys[0] == keys[1]) == (equal >= 1)
    assert V.with_key(df, context=None, variant=variant).columns == ["id", "text", "verdict_key"]


def test_a_second_run_scores_only_what_is_new(spark, tmp_path):
    path, scored = str(tmp_path / "store"), spark.sparkContext.accumulator(0)
    df = V.with_key(spark.range(60).selectExpr("id", "if(id % 3 = 0, 'hot', concat('t', id % 7)) AS text", "array(cast(id % 2 AS string)) AS context", "1 AS version", "'x' AS settled"))

    def score(rows):
        def count(batches):
            for b in batches:
                scored.add(len(b))
                yield b

        made = normalize.normalize(rows.select("verdict_key", "text")).select("verdict_key", "text")
        return made.mapInPandas(count, made.schema).withColumn("score", F.length("text") / 10).withColumn("pending", F.col("text") == "t1")

    first = V.cached(df.where("id < 30"), path, 1, score, ["score", "pending"], "id", keep=["text"]).collect()
    seen = scored.value
    assert seen == df.where("id < 30").select("verdict_key").distinct().count() and not any(r.from_store for r in first) and len(first) == 30
    second = V.cached(df, path, 2, score, ["score", "pending"], "id", keep=["text"]).collect()
    fresh = df.where("id >= 30").select("verdict_key").subtract(df.where("id < 30").select("verdict_key")).count()
    waiting = df.where("id < 30 AND text = 't1'").select("verdict_key").distinct().count()
    assert scored.value - seen == fresh + waiting and len(second) == 60 and waiting > 0
    assert {(r.id, r.score) for r in second} == {(r.id, len(r.text) / 10) for r in second}
    old = {r.verdict_key for r in first if r.text != "t1"}
    assert all(r.from_store == (r.verdict_key in old) for r in second)
    # The same version again: the same result, and nothing stored twice.
    again = V.cached(df, path, 2, score, ["score", "pending"], "id", keep=["text"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, second))
    table = spark.read.parquet(path)
    assert table.count() == table.select("verdict_key").distinct().count() and table.where("pending").count() == 0
    assert V.cached(df.limit(0), path, 3, score, ["score", "pending"], "id", keep=["text"]).collect() == []


def test_sources_of_cached_verdicts(spark):
    df = spark.createDataFrame([("rules", True, "T0 clear"), ("context", True, "x"), ("on_device", False, "T1 fallback")], "tier string, from_store boolean, source string")
    assert [r.s for r in df.select(V.cached_source().alias("s")).collect()] == ["cached T0", "cached T2", "T1 fallback"]
