"""What scoring costs: patterns that run only where they may match, texts that are normalised once, shuffles planned apart from the tiers."""
import random
import re

import pytest
from pyspark.sql import functions as F

from textguard import rulebook as B
from textguard.functions import arrays
from textguard.functions import text as T
from textguard.operators import cascade, normalize, rules
from textguard.plans import evaluate
from textguard.queries import catalog_text as X
from textguard.sources import readers
from textguard.streaming import streams


def drawn(nodes, rng: random.Random) -> str:
    """A string that the parsed pattern allows."""
    out = ""
    for op, arg in nodes:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "SUBPATTERN":
            out += drawn(arg[3], rng)
        elif kind == "BRANCH":
            out += drawn(rng.choice(arg[1]), rng)
        elif kind == "MAX_REPEAT":
            out += drawn(arg[2], rng) if rng.random() < 0.5 or arg[0] else ""
        elif kind == "IN":
            out += "w" if str(arg[0][0]) != "LITERAL" else chr(rng.choice(arg)[1])
        else:
            assert kind == "ASSERT_NOT", kind
    return out


PATTERNS = [(r[1], rules.fill(r[4]), B.TRIGGERS[r[1]]) for r in B.RULES]
PATTERNS += [(f"reporting {k}", p, B.REPORTING_TRIGGERS) for k, p in enumerate(B.REPORTING)] + [("affection", B.AFFECTION, B.AFFECTION_TRIGGERS)]


@pytest.mark.parametrize("name,pattern,triggers", PATTERNS, ids=[p[0] for p in PATTERNS])
def test_every_match_of_a_pattern_has_a_trigger(name, pattern, triggers):
    rng, known = random.Random(5), set(triggers.split())
    for _ in range(3000):
        line = drawn(re._parser.parse(pattern), rng)
        assert known & set(line.split()), line


def test_patterns_run_only_behind_their_triggers(spark):
    df = normalize.normalize(spark.createDataFrame([("you should just disappear",), ("the weather is fine",), (None,)], "text string"))
    plan = rules.rule_hits(df)._jdf.queryExecution().analyzed().toString()
    assert "_triggers" in plan
    got = {r.text: [x.hit for x in r.rules] for r in rules.rule_hits(df).collect()}
    assert got == {"you should just disappear": ["rule:just disappear"], "the weather is fine": [], None: []}


def test_words_by_the_table_of_ascii(spark):
    """Every character of ASCII and some beyond parts words as the spelled-out class does."""
    chars = [chr(c) for c in range(1, 128)]
    rows = [(f"a{c}B7{c}{c}9",) for c in chars] + [(f"a{c}bé",) for c in chars] + [("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select("t", T.tokenize(F.col("t")).alias("words"), T.squash(F.col("t")).alias("key"))
    for r in df.collect():
        if r.t is not None:
            letters = "".join(c for c in r.t if c.isalnum())
            assert r.words == [w for w in re.split(r"[^A-Za-z0-9é]+", r.t.replace("'", "")) if w] and r.key == re.sub(r"(?s)(.)\1+", r"\1", letters)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "[^A-Za-z0-9]" not in plan


def test_listed_words_keep_their_order_and_come_once(spark):
    df = spark.createDataFrame([(["b", "x", "a", "b"],), ([],), (None,)], "ws array<string>")
    got = df.selectExpr(f"{arrays.common('ws', ['a', 'b'])} AS c", f"{arrays.any_in('ws', ['x'])} AS x").collect()
    assert [(r.c, r.x) for r in got] == [(["b", "a"], True), ([], False), (None, None)]
    assert "array_intersect" not in arrays.common("ws", ["a"])


def test_guards_are_asked_where_the_pattern_is(spark):
    guard = rules.not_after(["not"], 2)
    rows = spark.createDataFrame([(" we love it ",), (" not really love ",), (" not so very love ",), (" glove ",)], "t string")
    pattern = rules.whole_words("love|like it", guard)
    assert [r.m for r in rows.selectExpr(f"t RLIKE {arrays.quote(pattern)} AS m").collect()] == [True, False, True, False]
    assert pattern.index("love") < pattern.index("(?<! ")


def test_parity_joins_scores_only(spark, tmp_path):
    spark.createDataFrame([(1, "you total l0ser"), (2, "fine day"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = X.verdict_parity(spark, str(tmp_path))
    assert "regexp" not in df._jdf.queryExecution().toString().lower()
    both = normalize.normalize(X.docs(spark, str(tmp_path)))
    plain = cascade.lexical_fallback_score(both.withColumn("word_set", F.col("tokens"))).select("doc_id", F.col("model_score").alias("score"))
    full = cascade.lexical_scorer(both).select("doc_id", F.col("model_score").alias("score"))
    assert df.collect() == evaluate.verdict_parity(full, plain, "doc_id").collect()


def test_fixtures_are_read_back_before_the_tiers(spark, tmp_path):
    rows = [(1, ["a: nobody likes you", "b: nobody likes you at all"], "nobody likes you", "hold"), (2, [], "fine day", "pass"), (2, ["x: i see"], "go die", "hold"), (None, None, None, "pass")]
    df = spark.createDataFrame(rows, "id long, context array<string>, draft string, expect string")
    replay = evaluate.fixture_replay(df, path=str(tmp_path / "f"))
    assert "Exchange" not in replay._jdf.queryExecution().executedPlan().toString()
    assert sorted(replay.collect(), key=str) == sorted(evaluate.fixture_replay(df).collect(), key=str)


def test_waiting_requests_are_stored_in_pieces(spark, tmp_path):
    """Each micro-batch writes its own rows; what already waits for the watermark is not written again in one row of state."""
    df = spark.range(600).selectExpr("'hot' AS k", "id", "1700000000000000L + (id * 7919) % 600 * 1000000 AS at")
    totals = []
    for j in range(3):
        df.where(f"id % 3 = {j}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = readers.message_stream(spark, f"{tmp_path}/in", df.schema)
        query = (streams.rate_limit(stream, "k", "at", "id", 3, 100, ordered=True, delay="1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
        query.awaitTermination()
        totals += [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]
    assert len(totals) == 3 and totals[0] > 1 and totals[2] >= totals[0] + 2
