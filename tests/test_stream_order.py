"""Stateful streams over shuffled files and several micro-batches, against the batch forms."""
import pytest
from pyspark.sql import functions as F

from textguard.operators.context import lookback
from textguard.plans import activity as A
from textguard.plans.quota import rate_limit
from textguard.queries import catalog_corpus as C
from textguard.sources import readers
from textguard.streaming import ordered, streams


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """360 edits of three keys in twelve files, whose rows are not in order of time."""
    path = str(tmp_path_factory.mktemp("shuffled") / "rows")
    (spark.range(360).selectExpr("id", "if(id % 5 = 0, 'b', if(id % 7 = 0, 'c', 'a')) AS k", "concat('l', id) AS text", "timestamp_seconds(1700000000 + id * 2 + (id div 10) * 70) AS ts")
            .withColumn("at", F.unix_micros("ts")).repartition(12, F.hash("id")).write.parquet(path))
    return spark.read.parquet(path)


def test_context_does_not_depend_on_the_files(spark, shuffled):
    got = C.streamed(spark, shuffled.drop("at"), lambda s: streams.stream_context(s, "k", "id", ts="ts", delay="30 days", ordered=True), ends="ts")
    want = lookback(shuffled, "k", "id", 12, "text", "context")
    assert {r.id: r.context for r in got.collect()} == {r.id: r.context for r in want.collect()} and got.count() == 360


def test_debounce_does_not_depend_on_the_files(spark, shuffled):
    got = C.streamed(spark, shuffled.select("k", "ts", "text"), lambda s: streams.debounced_stream(s, "k", gap_seconds=30, delay="30 days", ordered=True), ends="ts")
    want = A.debounce(shuffled, "k", "ts", "id", 30)
    drafts = sorted((r.k, r.text) for r in got.collect())
    assert drafts == sorted((r.k, r.text) for r in want.collect()) and len(drafts) > 60


def test_quota_does_not_depend_on_the_files(spark, shuffled):
    got = C.streamed(spark, shuffled.select("id", "k", "at"), lambda s: streams.rate_limit(s, "k", "at", "id", 3, 100, ordered=True, delay="30 days"), ends="at")
    want = rate_limit(shuffled, "k", "ts", "id", 3, 100)
    assert {r.id: r.granted for r in got.collect()} == {r.id: r.granted for r in want.collect()} and got.count() == 360


def test_rows_go_on_while_the_stream_runs(spark, tmp_path):
    df = spark.range(400).selectExpr("'a' AS k", "id AS i", "concat('l', id) AS text", "timestamp_seconds(1700000000 + id * 60) AS ts")
    for low in (0, 100, 200, 300):
        df.filter(f"i >= {low} AND i < {low + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = readers.message_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    query = (streams.stream_context(stream, "k", "i", ts="ts", delay="1 hour", ordered=True).writeStream.format("parquet")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    got = {r.i: r.context for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) >= 339 and all(c == [f"l{j}" for j in range(max(0, i - 12), i)] for i, c in got.items())


def test_an_older_edit_does_not_replace_a_newer_one(spark, tmp_path):
    rows = [("a", 100, "new", 0), ("a", 95, "old", 1), ("a", 50, "far", 1), ("z", 5000, "z", 2)]
    df = spark.createDataFrame(rows, "k string, s int, text string, f int").selectExpr("k", "timestamp_seconds(s) AS ts", "text", "f")
    for f in range(3):
        df.filter(F.col("f") == f).drop("f").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = readers.message_stream(spark, str(tmp_path / "in"), df.drop("f").schema, files_per_trigger=1)
    query = (streams.debounced_stream(stream, "k", gap_seconds=10, delay="1000 seconds").writeStream.format("parquet")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["far", "new"]


def test_queries_match_the_batch_forms(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.conv_id, r.turn): r.n for r in C.stream_context(spark, sf).collect()}
    want = lookback(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id", "turn", 12, "text", "context").collect()
    assert got == {(r.conv_id, r.turn): len(r.context) for r in want}
    assert C.stream_rate_limit(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def steps(spark, folder, parts, build):
    """Each part arrives as a file of its own micro-batch; returns the rows that came out and the progress of the batches."""
    progress = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = readers.message_stream(spark, f"{folder}/in", parts[0].schema)
        query = (build(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        progress += [p for p in query.recentProgress if p["numInputRows"]]
    return spark.read.parquet(f"{folder}/out").collect(), progress


def test_state_is_touched_by_what_arrives_only(spark, tmp_path):
    """A hot key's rows wait in hundreds; each micro-batch writes its own rows and no more."""
    df = spark.range(600).selectExpr("'hot' AS k", "id AS i", "concat('l', id) AS text", "timestamp_seconds(1700000000 + (id * 7919) % 600) AS ts")
    parts = [df.where(f"i % 5 = {j}") for j in range(5)]
    got, progress = steps(spark, tmp_path, parts, lambda s: streams.stream_context(s, "k", "i", ts="ts", delay="1 hour", width="10 minutes", ordered=True))
    touched = [sum(o["numRowsUpdated"] for o in p["stateOperators"]) for p in progress]
    assert got == [] and len(touched) == 5 and max(touched) <= 2 * min(touched) < 30


@pytest.mark.parametrize("piece, run", [(256, 16_384), (3, 10)])
def test_runs_and_pieces_give_the_same_order(spark, tmp_path, monkeypatch, piece, run):
    monkeypatch.setattr(ordered, "PIECE_ROWS", piece)
    monkeypatch.setattr(ordered, "RUN_ROWS", run)
    df = spark.range(200).selectExpr("if(id % 9 = 0, null, 'hot') AS k", "if(id % 10 = 3, null, id % 4) AS place", "id", "if(id % 6 = 0, null, concat('l', id)) AS text", "timestamp_seconds(1700000000 + ((id * 7919) % 200 div 8)) AS ts")
    df = df.union(df.where("id IN (5, 7)"))  # repeated rows are rows
    odd = df.limit(1).selectExpr("k", "place", "-1L AS id", "text", "cast(null AS timestamp) AS ts")  # without a time: dropped
    last = df.limit(1).selectExpr("'end' AS k", "place", "-2L AS id", "text", "timestamp'2200-01-01' AS ts")
    got, _ = steps(spark, tmp_path, [df.where("id % 2 = 0").union(odd), df.where("id % 2 = 1"), last], lambda s: streams.stream_context(s, "k", ["place", "id"], ts="ts", n=4, delay="1 hour", width="20 seconds", ordered=True))
    want = []
    for k in (None, "hot"):
        mine = sorted((r for r in df.collect() if r.k == k), key=lambda r: (r.ts, r.place is not None, r.place or 0, r.id))
        want += [(k, r.id, [x.text for x in mine[max(0, j - 4):j]]) for j, r in enumerate(mine)]
    assert sorted(((r.k, r.id, r.context) for r in got), key=repr) == sorted(want, key=repr)


def test_late_rows_are_dropped_and_silent_keys_forgotten(spark, tmp_path):
    def at(*rows):
        return spark.createDataFrame(rows, "k string, s long, text string").selectExpr("k", "s", "text", "timestamp_seconds(1700000000 + s) AS ts")

    day = 86400
    parts = [at(("a", 0, "one"), ("a", 5, "two")), at(("x", day, "x")), at(("a", 10, "late"), ("a", 2 * day, "three")), at(("x", 40 * day, "x")), at(("a", 41 * day, "four")), at(("x", 99 * day, "x"))]
    got, _ = steps(spark, tmp_path, parts, lambda s: streams.stream_context(s, "k", "s", ts="ts", delay="1 hour", ordered=True))
    assert {r.text: r.context for r in got if r.k == "a"} == {"one": [], "two": ["one"], "three": ["one", "two"], "four": []}


def test_short_gap_after_a_complete_word(spark, shuffled):
    df = shuffled.selectExpr("id", "k", "ts", "CASE id % 4 WHEN 0 THEN concat(text, '!') WHEN 1 THEN concat(text, '\u3000') WHEN 2 THEN text END AS text")
    got = C.replayed(spark, df, "ts", lambda s: streams.debounced_stream(s, "k", gap_seconds=60, short_gap_seconds=5, delay="10 minutes", width="7 minutes", ordered=True, tie=["id"]))
    want = A.debounce(df, "k", "ts", "id", 60, text="text", short_gap_seconds=5)
    long_gap = A.debounce(df, "k", "ts", "id", 60)
    drafts = sorted(r.id for r in got.collect())
    assert drafts == sorted(r.id for r in want.collect()) and len(drafts) > long_gap.count() > 0


def test_an_empty_stream_gives_nothing(spark, shuffled):
    none = shuffled.limit(0).select("id", "k", "ts", "text")
    assert C.replayed(spark, none, "ts", lambda s: streams.stream_context(s, "k", "id", ts="ts", delay="1 hour", ordered=True)).where("id IS NOT NULL").count() == 0


def test_a_debounced_hot_key_waits_as_a_row_a_cell(spark, tmp_path):
    """600 edits of one key within a minute, in five micro-batches: no Python keeps them, and each cell is one row of the state."""
    df = spark.range(600).selectExpr("'hot' AS k", "id", "concat('l', id) AS text", "timestamp_millis(1700000040000 + (id * 7919) % 600 * 100) AS ts")
    end = df.limit(1).selectExpr("'end' AS k", "id", "text", "timestamp'2200-01-01' AS ts")
    parts = [df.where(f"id % 5 = {j}") for j in range(5)]
    got, progress = steps(spark, tmp_path, [*parts, end], lambda s: streams.debounced_stream(s, "k", gap_seconds=60, delay="1 hour", width="10 minutes", ordered=True, tie=["id"]))
    operators = [o for p in progress[:5] for o in p["stateOperators"]]
    assert {o["operatorName"] for o in operators} == {"stateStoreSave"} and max(o["numRowsTotal"] for o in operators) == 1
    last = df.orderBy(F.desc("ts")).first()
    assert [(r.k, r.id) for r in got] == [("hot", last.id)]


def test_the_last_drafts_of_a_table_come_out(spark):
    """Drafts whose gap ends in the day after their own, with nothing behind them."""
    df = spark.range(40).selectExpr("id", "concat('k', id % 4) AS k", "concat('l', id) AS text", "timestamp'2024-01-01 23:20:00' + make_dt_interval(0, 0, id, 0) AS ts")
    got = C.replayed(spark, df, "ts", lambda s: streams.debounced_stream(s, "k", gap_seconds=600, short_gap_seconds=60, delay="1 hour", width="1 day", ordered=True, tie=["id"]))
    assert sorted(r.id for r in got.collect()) == [36, 37, 38, 39]


@pytest.mark.parametrize("gap, short", [(30, 0), (0, 30), (0, None), (45, 7)])
def test_gaps_of_nothing_and_uneven_gaps(spark, shuffled, gap, short):
    df = shuffled.selectExpr("id", "if(k = 'c', null, k) AS k", "ts", "if(id % 3 = 0, concat(text, ' '), if(id % 4 = 0, null, text)) AS text").where("id < 150")
    got = C.replayed(spark, df, "ts", lambda s: streams.debounced_stream(s, "k", gap_seconds=gap, short_gap_seconds=short, delay="10 minutes", width="1 minute", ordered=True, tie=["id"]), slices=2)
    want = A.debounce(df.withColumn("k", F.coalesce("k", F.lit("none"))), "k", "ts", "id", gap, text="text", short_gap_seconds=short)
    rows = [r.id for r in got.where("id IS NOT NULL").collect()]
    assert sorted(rows) == sorted(r.id for r in want.collect()) and rows
