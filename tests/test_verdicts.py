import pytest
from pyspark.sql import functions as F

from textguard.operators import cascade, policy, tier0
from textguard.plans import evaluate
from textguard.queries import QUERIES

HOLD = ["you are such an idiot", "ur so dumb lol", "what a loser", "go die", "kill yourself", "k y s", "idiot you are",
        "your face is disgusting", "i will hurt you", "nobody likes you", "f*ck this", "stfu loser", "you retard",
        "send nudes", "your mom is a cow", "you look like a potato", "shoot up the school", "u brat"]
PASS = ["this keyboard is stupid", "i could just die of laughter", "that film was trash", "your stupid charger broke",
        "he called me a moron", "i am such an idiot", "you are not stupid", "no one asked me to the dance",
        "summa cum laude", "thanks so much for helping", "you're so weird haha i love it", "shut up", "i want to die",
        "you're dead tired", "we should kill you know who", "i have 4 tickets", "love you loser"]
OWN_PAIN = ["i want to die", "i hate myself", "im so alone", "everyone would be better off without me", "i want to disappear"]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


@pytest.fixture(scope="module")
def scored(spark):
    df = cascade.local_verdict(tier0.tier0_verdict(frame(spark, HOLD + PASS + OWN_PAIN)))
    return {(r.text, r.sensitivity): r for r in policy.hold_policy(df).collect()}


def test_golden_lists(scored):
    assert [t for t in HOLD if not scored[t, "balanced"].held] == []
    assert [t for t in PASS if scored[t, "balanced"].held] == []


def test_own_pain_is_never_held(scored):
    for text in OWN_PAIN:
        for level in ("light", "balanced", "attentive"):
            row = scored[text, level]
            assert not row.held and row.distress and row.self_directed


def test_stricter_levels_hold_more(scored):
    for (text, level), row in scored.items():
        if row.held and level == "light":
            assert scored[text, "balanced"].held
        if row.held and level == "balanced":
            assert scored[text, "attentive"].held


def test_pile_on_raises_the_score(spark):
    line = "nice haircut there champ really nice haircut"
    cases = spark.createDataFrame([("solo", [], line, "pass"), ("pile", ["a: " + line, "b: " + line, "c: hello there"], line, "pass")],
                                  "id string, context array<string>, draft string, expect string")
    got = {r.id: r for r in evaluate.fixture_replay(cases).collect()}
    assert got["solo"].score == 0.0 and abs(got["pile"].score - 0.78) < 1e-9


def test_rule_scores_are_whole_word(spark):
    rows = {r.text: r for r in tier0.tier0_verdict(frame(spark, ["pinky swear", "proud of you", "classic pass", "die loser", "rot"])).collect()}
    assert rows["pinky swear"].score == 0 and rows["proud of you"].score == 0 and rows["classic pass"].score == 0
    assert rows["die loser"].score == 0.92 and "rule:bare command" in rows["rot"].hits


def test_scorer_sees_only_undecided_rows(spark):
    seen = []

    def scorer(df):
        seen.append(sorted(r.text for r in df.select("text").collect()))
        return df.withColumn("model_score", F.lit(0.99))

    df = tier0.tier0_verdict(frame(spark, ["kill yourself", "hello there friend", "you are something else"]))
    out = {r.text: r for r in cascade.local_verdict(df, scorer, transformer=True, reachable=True, lexical=False).collect()}
    assert seen == [["you are something else"]]
    assert out["you are something else"].pending and not out["kill yourself"].pending


def test_offline_fallback_believes_a_sure_model(spark):
    df = tier0.tier0_verdict(frame(spark, ["you are something else"]))
    sure = cascade.local_verdict(df, lambda d: d.withColumn("model_score", F.lit(0.99)), transformer=True, lexical=False).first()
    assert sure.score == 0.5 and sure.tier == "on_device" and sure.categories == ["insult"] and not sure.pending


def test_cached_verdict_scores_each_text_once_and_keeps_every_row(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("k", F.sha2("text", 256))
    calls = []

    def score(once):
        calls.append(once.count())
        return once.withColumn("score", F.length("text"))

    out = cascade.cached_verdict(df, "k", "text", score, row_id="id").collect()
    assert calls == [101] and len(out) == 300 and all(r.score == len(r.text) for r in out)


def test_span_redact_takes_the_last_occurrence(spark):
    df = spark.createDataFrame([("a b a c", "a"), ("x", "y"), ("aXXbXX", "XX"), ("t", "")], "text string, span string")
    got = [r[0] for r in df.select(cascade.span_redact("text", "span", "'_'")).collect()]
    assert got == ["a b _ c", "x", "aXXb_", "t"]


def test_rewrites(spark):
    pairs = spark.createDataFrame([("you idiot", '"please give me some space"'), ("x", "I'm sorry, but no"), ("x", "NONE"),
                                   ("x", "you are such an idiot"), ("x", "y" * 200)], "original string, rewrite string")
    got = [(r.clean[:10], r.usable, r.accepted) for r in cascade.rewrite_filter(pairs).collect()]
    assert got[0] == ("please giv", True, True)
    assert [g[2] for g in got] == [True, False, False, False, False]
    assert got[3][1] is True


def test_offending_span(spark):
    df = spark.createDataFrame([(1, "Hello there. You are an idiot. Bye now."), (2, "All fine. Really.")], "id int, text string")
    got = {r.id: r.span for r in cascade.offending_span(df, "id").collect()}
    assert got == {1: "You are an idiot.", 2: "All fine. Really."}


def test_group_rejoin_reads_split_messages(spark):
    df = spark.createDataFrame([(1, 1, 0, "you are"), (2, 1, 1, "such an"), (3, 1, 2, "idiot here"), (4, 2, 0, "hi you"), (5, 2, 1, "all good")],
                               "id int, g int, pos int, text string")
    covered = cascade.fragment_best(df, "id")
    assert covered.count() == 0
    got = cascade.group_rejoin(df, covered, "id", "g", "pos").collect()
    assert [(r.g, r.joined) for r in got] == [(1, "you are such an idiot here")]


def test_group_rejoin_scores_every_group(spark):
    rows = [(1, 1, 0, "you are"), (2, 1, 1, "such an"), (3, 1, 2, "idiot here"), (4, 2, 0, "hi you"), (5, 2, 1, "all good")]
    df = spark.createDataFrame(rows, "id int, g int, pos int, text string")
    got = {r.g: (r.score, r.held) for r in cascade.group_rejoin(df, cascade.fragment_best(df, "id"), "id", "g", "pos", every=True).collect()}
    assert set(got) == {1, 2} and got[1][0] >= 0.7 and got[1][1] is True and got[2] == (0.0, False)


def test_the_query_group_rejoin_judges_what_it_joins(spark, tmp_path):
    """A turn whose sentences pass one by one and are held as one text."""
    turns = [(83, 1, "user", "Oh you are. An idiot today."), (102, 1, "user", "All is fine. It works.")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.gid: r for r in QUERIES["group_rejoin"](spark, str(tmp_path)).collect()}
    assert {g: r.held for g, r in got.items()} == {8300001: True, 10200001: False}
    assert got[8300001].score >= 0.7 > got[10200001].score and all(r.digest and r.chars for r in got.values())
