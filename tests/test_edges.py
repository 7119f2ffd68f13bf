"""Edges: long words, odd masks, texts without words, null keys, reviews, own lexicons, large micro-batches."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textguard.operators import cascade, normalize, phrases, policy, tier0
from textguard.plans import activity
from textguard.queries import frames
from textguard.sources import sinks
from textguard.streaming import streams


def scores(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["score"] for r in cascade.moderate(df, **more).orderBy("id").collect()]


def test_guards_look_over_words_of_any_length(spark):
    lengths = (1, 39, 40, 41, 99, 100, 101, 5000)
    texts = [t for n in lengths for t in (f"i {'xy' * n} go die", f"nobody {'xy' * n} love you loser")] + ["i xyz go die", "nobody xyz love you loser"]
    found = scores(spark, texts)
    assert found == found[-2:] * (len(lengths) + 1)


def test_masks_with_any_sign_between_letters(spark):
    texts = ["f*\\y*ck", "a*.b", "f.*ck", "(f*ck", "[*]^$|?+", "\\*\\", "f*ck"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(normalize.resolve_masks("text")).collect()]
    assert got[0] == texts[0] and got[1] == texts[1] and got[-1] == "fuck"


def test_no_words_is_trivial_even_in_context(spark):
    rows = [(0, "...", 3, [["a"], ["b"], ["c"]]), (1, "", 3, [["a"], ["b"], ["c"]]), (2, "!?", 0, [])]
    df = spark.createDataFrame(rows, "id int, text string, context_size int, context_words array<array<string>>")
    for r in tier0.tier0_verdict(df).collect():
        assert (r["ambiguity"], r["trivial"], r["score"]) == (0, True, 0)


def test_a_reviewer_settles_a_pending_message(spark):
    def certain(df):
        return df.withColumn("model_score", F.lit(0.99))

    df = spark.createDataFrame([(0, "you are something else"), (1, "you are something else")], "id int, text string")
    local = cascade.local_verdict(tier0.tier0_verdict(df), certain, transformer=True, reachable=True, lexical=False).withColumn("latency_ms", F.lit(1.0))
    assert all(r["pending"] and r["model_score"] == 0.99 for r in local.collect())
    review = spark.createDataFrame([(0, 0.0, 0.9, [], "fine", False, 5.0)], "id int, r_score double, r_confidence double, r_categories array<string>, r_rationale string, r_self_directed boolean, r_latency_ms double")
    for merged in (cascade.merge_review(local, review, "id"), cascade.cascade_route(local, review, "id")):
        by = {r["id"]: r for r in merged.collect()}
        assert (by[0]["pending"], by[0]["model_score"], by[0]["score"]) == (False, 0.0, 0.0)
    covered = {(r["id"], r["sensitivity"]): r["covered"] for r in policy.cover_policy(cascade.merge_review(local, review, "id")).collect()}
    assert not any(c for (i, _), c in covered.items() if i == 0) and covered[1, "attentive"]


def test_own_terms_of_a_lexicon_are_found(spark):
    df = normalize.normalize(spark.createDataFrame([(1, "zorbo zorbo idiot"), (2, None)], "id int, text string"))
    lexicon = spark.createDataFrame([("own", "word", "zorbo"), ("own", "word", "zorbo"), ("built in", "word", "idiot"), ("own", "phrase", "zorbo idiot")], "list string, kind string, term string")
    assert sorted(tuple(r) for r in phrases.word_hits(df, "id", lexicon).collect()) == [(1, "built in", "idiot"), (1, "own", "zorbo")]


def test_null_keys_are_keys(spark):
    start = datetime(2024, 1, 1, 10)
    rows = [(k, None if k % 2 else "a", start + timedelta(seconds=k), "t%d" % (k % 3) if k % 4 else None, k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, text string, app int")
    assert activity.running_quota(df, "k", "ts", "id").count() == 40
    assert {r["k"]: r["edits"] for r in activity.typing_sessions(df.na.fill({"text": "x"}), "k", "app", "ts", "text", "id").collect()} == {"a": 20, None: 20}
    assert {(r["k"], r["deferred"]): r["n"] for r in activity.budgeted_batch(df, "k", "id", 5).groupBy("k", "deferred").agg(F.count("*").alias("n")).collect()} == {("a", False): 5, ("a", True): 15, (None, False): 5, (None, True): 15}
    keyed = df.select("id", "text", F.sha2("text", 256).alias("key"))
    scored = cascade.cached_verdict(keyed, "key", "text", lambda d: d.withColumn("n", F.coalesce(F.char_length("text"), F.lit(0))), row_id="id")
    assert sorted((r["id"], r["n"]) for r in scored.collect()) == [(k, 2 if k % 4 else 0) for k in range(40)]


def test_a_report_has_every_event(spark):
    rows = [(k, "a", "caught", 0.5, "t", None, None, None, datetime(2024, 1, 1) + timedelta(hours=k)) for k in range(61)]
    df = spark.createDataFrame(rows, "event_id long, install_id string, kind string, score double, text string, rewritten string, reason string, app string, occurred_at timestamp")
    assert sinks.report_entries(df).count() == 61
    assert sinks.newest_report(df, 60).first()["entries"] == 60


def test_equal_stamps_are_settled_the_same_way(spark):
    rows = [("a", 1, k) for k in range(50)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    assert {sinks.latest(df.repartition(n), ["k"], "at").first()["v"] for n in (1, 3, 7)} == {49}


def test_ids_do_not_collide_at_a_thousand_turns(spark, tmp_path):
    rows = [(c, t, "user", "one. two.") for c in (1, 2) for t in (0, 999, 1000, 1001, 99_999)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = frames.messages(spark, str(tmp_path))
    assert got.count() == got.select("msg_id").distinct().count() == 20


def streamed(spark, df, folder, fn):
    df.write.parquet(str(folder / "in"))
    out = fn(spark.readStream.schema(df.schema).parquet(str(folder / "in")))
    query = out.writeStream.format("parquet").option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start(str(folder / "out"))
    query.awaitTermination()
    return spark.read.parquet(str(folder / "out"))


@pytest.mark.parametrize("ts", [None, "ts"])
def test_stream_context_of_a_key_with_many_rows(spark, tmp_path, ts):
    n = 25_000
    df = spark.range(n).select(F.lit("hot").alias("k"), (F.lit(n - 1) - F.col("id")).alias("i"), F.format_string("l%d", F.lit(n - 1) - F.col("id")).alias("text"),
                               F.timestamp_seconds(F.lit(1700000000) - F.col("id")).alias("ts")).coalesce(1)
    got = streamed(spark, df, tmp_path, lambda s: streams.stream_context(s, "k", "i", ts=ts))
    wrong = got.filter("context != transform(sequence(greatest(i - 12, 0), greatest(i - 1, 0)), x -> concat('l', x)) AND i > 0 OR i = 0 AND size(context) > 0")
    assert got.count() == n and wrong.count() == 0


def test_debounce_of_a_key_with_many_rows(spark, tmp_path):
    n = 25_000  # newest first; a pause after each tenth
    df = spark.range(n).select((F.lit(n - 1) - F.col("id")).alias("i")).select(F.lit("hot").alias("k"), F.expr("timestamp_millis(1700000000000 + i * 100 + (i div 10) * 2000)").alias("ts"), F.format_string("d%d", "i").alias("text")).coalesce(1)
    got = streamed(spark, df, tmp_path, lambda s: streams.debounced_stream(s, "k"))
    drafts = sorted(int(r["text"][1:]) for r in got.collect())
    assert drafts[:2499] == [10 * k + 9 for k in range(2499)]


@pytest.mark.parametrize("typos", [False, True])
def test_typos_reach_the_cascade(spark, typos):
    forms = normalize.surviving_typos(spark, None) if typos else None
    found = scores(spark, ["you morom"], typos=forms)[0]
    assert (found >= 0.35) == typos
