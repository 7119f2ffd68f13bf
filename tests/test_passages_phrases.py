"""Best passages, phrase tables and the model's second look, each against a plain computation."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import cascade, normalize, passages, phrase_index, phrases, tier0
from textguard.operators.model_scorer import DISGUISES, BatchScorer
from textguard.queries.frames import CARRIERS


def long_texts(n=12):
    rng = random.Random(5)
    filler = ["the", "meeting", "is", "at", "noon", "and", "rain", "falls"]
    out = [(0, ""), (1, None), (2, "short and kind"), (3, "you are such an idiot"), (4, "rain falls at noon " * 150 + "you are such an idiot")]
    for i in range(5, n):
        words = [rng.choice(filler) for _ in range(rng.randrange(50, 900))]
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words)), rng.choice(CARRIERS))
        out.append((i, rng.choice([" ", "\n"]).join(words)))
    return out


# ------------------------------------------------------------------ N19
def windows_of(text, size, step):
    """Each window by a plain walk: (start, text)."""
    starts = [0] if len(text) <= size else list(range(0, len(text) - size + step, step))
    for s in starts:
        cut = text[s:s + size]
        if s and not text[s - 1].isspace():
            cut = cut[next((i for i, c in enumerate(cut) if c.isspace()), len(cut)):]
        yield s, cut


@pytest.mark.parametrize("size, step", [(300, 120), (1500, 640)])
def test_best_passage_is_the_brute_force_maximum(spark, size, step):
    rows = long_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("x"), "score": F.lit("y"), "passage": F.lit(1)})
    got = {r.doc_id: (r.start, r.score, r.passages) for r in passages.best_passage(df, "doc_id", size=size, step=step).collect()}
    flat = [(i, s, w) for i, t in rows for s, w in windows_of(t or "", size, step)]
    judged = cascade.moderate(spark.createDataFrame(flat, "id long, at long, w string"), "w", keep=["id", "at"]).select("id", "at", "score").collect()
    want = {}
    for r in judged:
        n = want.get(r.id, (0, -1.0, 0))
        want[r.id] = ((r["at"], r.score) if (r.score, -r["at"]) > (n[1], -n[0]) else n[:2]) + (n[2] + 1,)
    assert got == want and max(s for _, s, _ in got.values()) > 0.7 and any(s > 0 for s, _, _ in got.values())
    assert got[0] == got[1] == (0, 0.0, 1)


def test_best_passage_ties_repeats_and_the_way_back(spark):
    def score(w):
        return w.withColumn("score", F.expr("if(contains(passage_text, 'x'), 1e0, 0e0)"))
    rows = [(1, "a " * 50), (1, "b " * 60 + "x"), (2, "x " + "c " * 99 + "x"), (None, "d"), (None, "x")]
    df = spark.createDataFrame(rows, "k long, text string")
    got = {r.k: r for r in passages.best_passage(df, "k", size=50, step=20, score_fn=score).collect()}
    assert (got[1].score, got[2].start, got[None].score, got[None].passages) == (1.0, 0, 1.0, 2)
    one = spark.createDataFrame(rows[2:3], "k long, text string").join(passages.best_passage(df.filter("k = 2"), "k", size=50, step=20, score_fn=score), "k")
    assert one.select(passages.passage_at("text", size=50)).first()[0] == rows[2][1][:50]
    assert passages.best_passage(df.filter("false"), "k", score_fn=score).collect() == []
    with pytest.raises(ValueError):
        passages.best_passage(df, "k", size=10, step=20)


def test_best_passage_shuffles_no_text(spark):
    df = spark.createDataFrame(long_texts(), "doc_id long, text string")
    plan = passages.best_passage(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 1 and "partial_max" in plan


# ------------------------------------------------------------------ X3
def test_phrase_table_equals_the_built_in_lists(spark, tmp_path):
    rng = random.Random(2)
    every = [p for terms in phrases.PHRASE_LISTS.values() for p in terms]
    rows = [(i, f"{rng.choice(CARRIERS)} {rng.choice(every)} and {' '.join(rng.choice(every))}") for i in range(150)] + [(900, None), (901, "")]
    texts = normalize.normalize(spark.createDataFrame(rows, "id long, text string"))
    wide = phrases.phrase_hits(phrases.with_found(texts))
    want = {(r.id, name, p) for r in wide.collect() for name in phrases.PHRASE_LISTS for p in r[f"{name}_hits"] or []}
    got = phrase_index.phrase_matches(texts, phrase_index.builtin_phrases(spark), "id", str(tmp_path / "a"))
    rows = [(r.id, r.list, r.phrase) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 150


def test_phrase_table_edges(spark, tmp_path):
    given = [("l", "You're DEAD", False), ("l", "k y s", None), ("l", "you", True), ("l", "you", True), ("m", "you", False), ("l", None, False), ("l", "!!", False), (None, "so dumb", False)]
    table = phrase_index.with_needles(spark.createDataFrame(given, "list string, phrase string, evasive boolean"))
    texts = spark.createDataFrame([(1, "ur dead", "z"), (2, "youth", "z"), (2, "are you ok", "z"), (None, "you", "z"), (3, None, "z"), (4, "", "z"), (5, "you so DUMB", "z")], "id long, text string, word string")
    got = phrase_index.phrase_matches(normalize.normalize(texts).withColumn("needle", F.lit("q")), table, "id", str(tmp_path / "a"))
    said = {(r.id, r.list, r.phrase) for r in got.collect()}
    assert {(2, "l", "you"), (2, "m", "you"), (5, "l", "you"), (5, "m", "you"), (5, None, "so dumb")} <= said
    assert not any(i in (None, 3, 4) or p in (None, "!!") for i, _, p in said)
    empty = normalize.normalize(texts.filter("false"))
    assert phrase_index.phrase_matches(empty, table, "id", str(tmp_path / "b")).collect() == []
    assert phrase_index.phrase_matches(normalize.normalize(texts), table.filter("false"), "id", str(tmp_path / "c")).collect() == []


def test_a_hundred_thousand_phrases_and_a_hot_word(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phrase_index, "HOT_SHARE", 0.01)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    listed = {" ".join(rng.choice(vocab) for _ in range(rng.choice([2, 2, 3]))) for _ in range(100_000)} | {"hot", "hot hot", "hot w1"}
    rows = [(i, " ".join(["hot"] * (i % 3) + [rng.choice(vocab) for _ in range(25)])) for i in range(4000)]
    texts = spark.createDataFrame(rows, "id long, text string").select("id", F.concat(F.lit(" "), "text", F.lit(" ")).alias("ctext"))
    table = spark.createDataFrame([("l", p, False, f" {p} ") for p in listed], "list string, phrase string, evasive boolean, needle string")
    found = phrase_index.phrase_matches(texts, table, "id", str(tmp_path / "a"), joined=None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(i, " ".join(ws[a:a + n])) for i, t in rows for ws in [t.split()] for n in (1, 2, 3) for a in range(len(ws) - n + 1)}
    assert {(r.id, r.phrase) for r in found.collect()} == {(i, p) for i, p in want if p in listed}


def test_a_phrase_is_posted_under_its_rarest_part(spark):
    needles = spark.createDataFrame([(" a b c ",), (" b c ",), (" c d ",), (" a ",), (" a a ",)], "needle string")
    counts = spark.createDataFrame([("a b", 9), ("b c", 4), ("a", 70), ("a a", 1), ("c", 1)], "part string, n long")
    assert {(r.needle, r.part, r.n) for r in phrase_index.rarest_parts(needles, counts).collect()} == {(" a b c ", "b c", 4), (" b c ", "b c", 4), (" a ", "a", 70), (" a a ", "a a", 1)}


def test_phrase_table_stores_no_texts(spark, tmp_path):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(5000)]
    rows = [(i, " " + " ".join(rng.choice(vocab) for _ in range(400)) + " ") for i in range(300)]
    listed = [" ".join(t.split()[7:11]) for _, t in rows[:50]]
    table = spark.createDataFrame([("l", p, False, f" {p} ") for p in listed], "list string, phrase string, evasive boolean, needle string")
    found = phrase_index.phrase_matches(spark.createDataFrame(rows, "id long, ctext string"), table, "id", str(tmp_path / "a"), joined=None).collect()
    assert {(r.id, r.phrase) for r in found} == {(i, p) for i, t in rows for p in listed if f" {p} " in t}
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert written < sum(len(t) for _, t in rows) / 10


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_phrases_are_where_their_needles_are(spark, chunk):
    rng = random.Random(5)
    words = ["a", "b", "é", "😀", "ab", ""]
    forms = ["", " ", "  ", "a", " a", "a ", " a b ", "a b c", " a  b "] + [rng.choice(["", " "]) + " ".join(rng.choice(words) for _ in range(rng.randrange(60))) + rng.choice(["", " "]) for _ in range(300)]
    runs = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(400)} - {""})
    table = spark.createDataFrame([(r,) for r in runs], "run string")
    bitmap, bits, sizes = phrase_index.known_runs(table)
    assert sizes == sorted({r.count(" ") + 1 for r in runs})
    data, borders = phrase_index.utf8(pa.array(["cut off", *forms])[1:])
    met, before = set(), phrase_index.CHUNK
    phrase_index.CHUNK = chunk
    try:
        for a, b in phrase_index.chunks(borders):
            met |= {(a + t, r.decode()) for t, r in phrase_index.runs_met(data[borders[a]:borders[b]], borders[a:b + 1] - borders[a], bitmap, bits, sizes)}
    finally:
        phrase_index.CHUNK = before
    want = {(i, r) for i, form in enumerate(forms) for r in runs if f" {r} " in form}
    assert len(want) > 500 and want <= met and len(met - want) < 20


def test_evasive_phrases_in_the_joined_form(spark, tmp_path):
    texts = [(1, " k y s ", " kys "), (1, " go ", " go "), (None, " kys ", " kys "), (2, None, " kys "), (3, " kys now then you five six ", None), (4, " now then you five ", " now then you five ")]
    table = [("l", "kys", True, " kys "), ("l", "go", None, " go "), ("m", "kys", False, " kys "), ("l", "long", False, " now then you five six "), ("l", "word", True, " absent "), ("l", "gap", False, "  ")]
    df, rows = spark.createDataFrame(texts, "id long, ctext string, cjoined string"), spark.createDataFrame(table, "list string, phrase string, evasive boolean, needle string")
    got = phrase_index.phrase_matches(df, rows, "id", str(tmp_path / "a")).collect()
    assert sorted(map(tuple, got)) == [(1, "l", "go"), (1, "l", "kys"), (2, "l", "kys"), (3, "l", "kys"), (3, "l", "long"), (3, "m", "kys")]


def test_padded_words_are_the_words_padded(spark):
    texts = ["", " ", "don't stop", "'", "a-b  c", "--a", "a--", "Ünï cödé, 'quoted'! ٣ x", "é", "…", "tab\tnew\nline", "\0a\x1fb", None, "ß²½", "a\u00a0b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.padded_words(F.col("t")).alias("got"), T.padded(T.tokenize(F.col("t"))).alias("want"))
    assert all(r.got == r.want for r in df.collect())


# ------------------------------------------------------------------ X1 / C1
def counting_model(folder):
    """A stand-in that writes down each text it reads; 'loser' is 0.9, 'bad' 0.6, 'nan' no number."""
    def load():
        def model(texts):
            import os
            import uuid
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(t.replace("\n", " ") for t in texts) + "\n")
            return np.array([np.nan if "nan" in t else 0.9 if "loser" in t.lower() else 0.6 if "bad" in t else 0.1 for t in texts])
        return model
    return load


def test_the_higher_of_two_looks(spark, tmp_path):
    texts = ["l0ser", "LOSER", "a bad l0ser", "nice", "b4d", "room 101", "", None, "  ", "nan"]
    df = normalize.normalize(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).withColumn("looks", F.lit(7))
    got = {r.id: (round(r.model_score, 6), r.looks) for r in BatchScorer(counting_model(str(tmp_path)), batch_size=3)(df).collect()}
    plain = {r.id: r.plain for r in df.collect()}
    for i, t in enumerate(texts):
        bare = (t or "").strip()
        looks = [x for x in [bare, plain[i] if any(c in DISGUISES for c in bare) and plain[i] != bare.lower() else ""] if x]
        score = max([0.0 if "nan" in x else 0.9 if "loser" in x.lower() else 0.6 if "bad" in x else 0.1 for x in looks], default=0.0)
        assert got[i] == (score, len(looks)), t
    assert got[0] == (0.9, 2) and got[4] == (0.6, 2) and got[3] == (0.1, 1)
    with pytest.raises(ValueError):
        BatchScorer(counting_model(str(tmp_path)))(df.drop("plain"))


def test_the_model_reads_undecided_rows_only(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(CARRIERS + ["", None])]
    verdicts = tier0.tier0_verdict(spark.createDataFrame(rows, "id int, text string"))
    scorer = BatchScorer(counting_model(str(tmp_path)))
    out = cascade.local_verdict(verdicts, scorer, transformer=True, lexical=False).collect()
    read = [line for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    decided = {r.id for r in verdicts.collect() if r.self_directed or r.trivial or r.score >= 0.85}
    assert len(read) == sum(r.looks for r in out) and 0 < len(decided) < len(rows)
    assert all((r.looks, r.model_score) == (0, 0.0) for r in out if r.id in decided)
    assert all(r.looks >= 1 for r in out if r.id not in decided and (r.text or "").strip())
    # Any other callable gets the undecided part of the frame; the rows come out alike.
    beside = cascade.local_verdict(verdicts, lambda df: scorer(df).drop("looks"), transformer=True, lexical=False).collect()
    assert {(r.id, r.model_score, r.score, r.tier) for r in beside} == {(r.id, r.model_score, r.score, r.tier) for r in out}
