import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from textguard.plans import activity as A
from textguard.plans import corpus, rollups
from textguard.sources import readers, sinks
from textguard.streaming import streams


def test_label_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,comment_text,label\n1,"two\nlines, and ""quotes""",1\n2,plain,0\n3\n')
    got = {r.text: r.label for r in readers.read_label_csv(spark, str(tmp_path), "comment_text", "label").collect()}
    assert got == {'two\nlines, and "quotes"': "1", "plain": "0"}
    again = readers.read_label_csv(spark, str(tmp_path), "nothing", "label", text_at=1)
    assert again.count() == 2


def test_fixtures_and_wordlist(spark, tmp_path):
    case = {"id": "a", "title": "t", "note": "n", "expect": "pass", "context": ["x: hi"], "draft": "hello"}
    (tmp_path / "f.json").write_text(json.dumps({"version": 1, "cases": [case, {**case, "id": "b"}]}, indent=1))
    assert [r.id for r in readers.read_fixtures(spark, str(tmp_path / "f.json")).collect()] == ["a", "b"]
    (tmp_path / "w.txt").write_text("alpha\nbeta\r\ngamma\n")
    assert {(r.term, r.id) for r in readers.read_wordlist(spark, str(tmp_path / "w.txt")).collect()} == {("alpha", 0), ("beta", 1), ("gamma", 2)}


def test_daily_upsert_rewrites_only_arriving_days(spark, tmp_path):
    path = str(tmp_path / "daily")
    schema = "install_id string, day date, caught int, updated_at timestamp"
    d1, d2 = date(2024, 1, 1), date(2024, 1, 2)
    sinks.sink_daily_stats(spark.createDataFrame([("a", d1, 1, datetime(2024, 1, 1, 5)), ("a", d2, 1, datetime(2024, 1, 2, 5))], schema), path)
    sinks.sink_daily_stats(spark.createDataFrame([("a", d2, 7, datetime(2024, 1, 2, 6)), ("b", d2, 2, datetime(2024, 1, 2, 6))], schema), path)
    sinks.sink_daily_stats(spark.createDataFrame([("a", d2, 3, datetime(2024, 1, 2, 1))], schema), path)  # an older write loses
    got = {(r.install_id, r.day): r.caught for r in spark.read.parquet(path).collect()}
    assert got == {("a", d1): 1, ("a", d2): 7, ("b", d2): 2}


def test_events_and_report_files(spark, tmp_path):
    rows = [(1, "a", "caught", 1.4, "hi", None, "why", "chat", datetime(2024, 1, 1, 5)), (2, "a", "resources", 0.0, "t", None, None, None, datetime(2024, 1, 2, 5))]
    df = spark.createDataFrame(rows, "event_id long, install_id string, kind string, score double, text string, rewritten string, reason string, app string, occurred_at timestamp")
    sinks.sink_events(df, str(tmp_path / "e"))
    sinks.sink_events(df, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).agg(F.count("*"), F.max("score")).first()[:] == (4, 1.0)
    body = sinks.newest_report(df, 60).first().body
    assert body.index("2024-01-02") < body.index("2024-01-01")
    assert "- **Severity:** Cruel (140%)" in body and body.count("**Message:**") == 1 and "Rewritten" not in body
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).count() >= 1


def test_review_replies(spark):
    raw = ['{"score": 1.7, "confidence": -1, "categories": ["insult", "nope"], "rationale": " r ", "self_directed_distress": false}',
           '{"score": 0.9, "confidence": 0.5, "categories": [], "rationale": "", "self_directed_distress": true}',
           '{"score": 0.9}', "not json", None]
    good, bad = readers.review_verdicts(spark.createDataFrame(list(enumerate(raw)), "id int, raw string"), "id")
    rows = {r.id: r for r in good.collect()}
    assert (rows[0].r_score, rows[0].r_confidence, rows[0].r_categories, rows[0].r_rationale) == (1.0, 0.0, ["insult"], "r")
    assert rows[1].r_score == 0 and rows[1].r_self_directed
    assert sorted(r.id for r in bad.collect()) == [2, 3, 4]


def test_checks_pass_on_null(spark):
    df = spark.createDataFrame([(1, "caught", 0.5, None, None, None), (2, "nope", 2.0, "Odd", "rules", -1)],
                               "id int, kind string, score double, severity string, tier string, text_length int")
    good, bad = A.constraint_check(df, "events")
    assert [r.id for r in good.collect()] == [1]
    assert bad.first().violations == ["kind", "score", "severity", "text_length"]


def test_nothing_caught_has_no_percentage(spark):
    zero = spark.createDataFrame([("a", date(2024, 1, 1), *[0] * 8)], "install_id string, day date, " + ", ".join(f"{c} int" for c in rollups.COUNTERS))
    assert rollups.daily_totals(zero).first().pct_reconsidered is None


def test_class_cap_is_exact_and_repeatable(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE id % 3 WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' ELSE 'swear' END AS cls")
    one = {(r.cls, r.doc_id) for r in corpus.class_cap(df, {"neg": 123, "swear": 5000}).collect()}
    two = {(r.cls, r.doc_id) for r in corpus.class_cap(df.repartition(3), {"neg": 123, "swear": 5000}).collect()}
    assert one == two and len([1 for c, _ in one if c == "neg"]) == 123 and len(one) == 2123


def run(stream, tmp_path, mode="append"):
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / "out"))


def files(spark, df, tmp_path, parts):
    for i, part in enumerate(parts):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return readers.message_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)


def test_stream_quota_equals_batch(spark, tmp_path):
    from textguard.plans.quota import rate_limit
    df = spark.range(200).selectExpr("id", "if(id % 3 = 0, 'hot', 'cold') AS k", "id * 7000000 AS at", "timestamp_micros(id * 7000000) AS ts")
    stream = files(spark, df.select("id", "k", "at"), tmp_path, ["id < 90", "id >= 90"])
    got = {r.id: r.granted for r in run(streams.rate_limit(stream, "k", "at", "id", 3, 50), tmp_path).collect()}
    want = {r.id: r.granted for r in rate_limit(df, "k", "ts", "id", 3, 50).collect()}
    assert got == want


def test_stream_context_keeps_twelve_lines(spark, tmp_path):
    df = spark.range(40).selectExpr("id % 2 AS conv_id", "id AS turn", "concat('line ', id) AS text")
    stream = files(spark, df, tmp_path, ["turn < 20", "turn >= 20"])
    got = {r.turn: r.context for r in run(streams.stream_context(stream, "conv_id", "turn"), tmp_path).collect()}
    assert got[0] == [] and got[39] == [f"line {i}" for i in range(15, 39, 2)]


def test_stream_debounce_emits_settled_drafts(spark, tmp_path):
    rows = [("a", 0, "h"), ("a", 1, "he"), ("a", 100, "hey"), ("b", 5, "yo"), ("a", 5000, "z"), ("b", 5000, "z")]
    df = spark.createDataFrame(rows, "k string, s int, text string").selectExpr("k", "timestamp_seconds(s) AS ts", "text")
    stream = files(spark, df, tmp_path, ["unix_seconds(ts) < 1000", "unix_seconds(ts) >= 1000"])
    got = {(r.k, r.text) for r in run(streams.debounced_stream(stream, "k", gap_seconds=10), tmp_path).collect()}
    assert got >= {("a", "he"), ("a", "hey"), ("b", "yo")} and ("a", "h") not in got


def test_bow_model_plugs_in_as_a_scorer(spark):
    rows = [(["you", "idiot"], "harmful"), (["nice", "day"], "ok"), (["such", "idiot"], "harmful"), (["good", "day"], "ok")] * 5
    model = corpus.train_bow(spark.createDataFrame(rows, "tokens array<string>, label string"))
    score = corpus.model_scorer(model)
    got = [r.model_score for r in score(spark.createDataFrame([(["idiot"],), (["day"],)], "tokens array<string>")).collect()]
    assert got[0] > 0.5 > got[1]


def test_slot_fill_draws_from_the_grammar(spark):
    frames, slots = ["{you} a {noun}", "what a {noun}"], {"you": ["ur", "you are"], "noun": ["idiot", "clown"]}
    rows = [r.line for r in corpus.slot_fill(spark.range(500), frames, slots, "id").collect()]
    every = {f"{y} {a}" for y in ("ur", "you are", "what") for a in ("an idiot", "a clown")}
    assert set(rows) == every and len(rows) == len(every)


def test_line_numbers_over_split_files(spark, tmp_path):
    texts = ["".join(f"w{i}\n" if i % 7 else "\n" for i in range(50)), "einzeln", "", "".join(f"é{i}\r\n" for i in range(40)) + "\r\n", "tail\n\nend\n"]
    folder = tmp_path / "words"
    folder.mkdir()
    for k, text in enumerate(texts):
        (folder / f"part-{k}.txt").write_bytes(text.encode())
    want, n = [], 0
    for text in texts:
        for line in text.removesuffix("\n").split("\n") if text else []:
            if line.removesuffix("\r"):
                want.append((n, line.removesuffix("\r")))
            n += 1
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "37"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "4m" if size == "128m" else "1")
            assert sorted((r.id, r.term) for r in readers.read_wordlist(spark, str(folder)).collect()) == want
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("text, n", [("two words", 2), ("a,b", 3), ("中文字", 3), ("ab中cd", 3), ("\U00020000\u3400\uf900x", 4), ("a\u0000b\u200dc\ufeffd\ufffde\u0007f", 1), ("a\tb\nc\rd\u00a0e\u3000f", 6),
                                     ("カナかな", 1), ("한국 말", 2), ("$5+3=8", 6), ("\u0001\u200b", 0), ("", 0), ("été naïf", 2), ("a\u2028b", 1)])
def test_basic_tokens(spark, text, n):
    from textguard.plans import evaluate
    assert evaluate.token_lengths(spark.createDataFrame([(1, text)], "id int, text string"), "id").first().n_tokens == n
