"""Work that scoring leaves out: columns nobody asked for, texts that cannot score, passes over what is already known."""
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from textguard import lexicon as L
from textguard.functions import text as T
from textguard.operators import cascade, normalize, phrases, tier0
from textguard.plans import corpus, evaluate
from textguard.queries import catalog_corpus, frames
from textguard.queries import catalog_text as X
from textguard.streaming import streams


def plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_bow_model_scores_in_a_session_that_observed_something(spark):
    """A fitted model holds its session; once a session has an observation manager it cannot be sent to tasks."""
    spark.range(3).observe(Observation("seen"), F.count("*")).collect()
    rows = [(["you", "idiot"], "harmful"), (["nice", "day"], "ok")] * 5
    score = corpus.model_scorer(corpus.train_bow(spark.createDataFrame(rows, "tokens array<string>, label string")))
    got = [r.model_score for r in score(spark.createDataFrame([(["idiot"],), (["day"],)], "tokens array<string>")).collect()]
    assert got[0] > 0.5 > got[1]


def test_training_rows_are_normalised_once(spark, tmp_path):
    spark.createDataFrame([(1, "so n1ce"), (2, "you 1diot"), (3, None), (None, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 1), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = catalog_corpus.training(spark, str(tmp_path))
    assert "regexp_replace" not in plan(df)
    got = sorted((r.doc_id, r.tokens, r.label) for r in df.collect())
    assert got == [(1, ["so", "nice"], "ok"), (2, ["you", "idiot"], "harmful"), (2, ["you", "idiot"], "harmful"), (3, [], "harmful")]


def test_normalize_keeps_what_is_asked_for(spark):
    df = spark.createDataFrame([(1, "Y0u  @re soooo d*mb", "p")], "id long, text string, plain string")
    full = normalize.normalize(df).first().asDict()
    for keep in (["tokens"], ["canonical"], ["ctext", "cjoined"], ["squashed"], normalize.LEXICAL):
        part = normalize.normalize(df.drop("plain"), keep=keep)
        assert set(part.columns) == {"id", "text", *keep}
        assert part.first().asDict() == {c: full[c] for c in part.columns}
    assert normalize.normalize(df, keep=["tokens"]).columns == ["id", "text", "plain", "tokens"]


@pytest.mark.parametrize("query,spared", [(X.join_singles, "destretched"), (X.word_hits, "cjoined"), (X.insult_aim_documents, "cjoined"), (X.evaluate_classifier, "cjoined")])
def test_document_queries_settle_what_they_read(spark, tmp_path, query, spared):
    spark.createDataFrame([(1, "you i d i o t"), (2, "fine")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = query(spark, str(tmp_path))
    settled = [x for x in plan(df).split("\n") if "Generate explode(array(struct(" in x]
    assert settled and not any(f"{spared}#" in x for x in settled)
    df.collect()


def test_only_labelled_documents_are_scored(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    assert sorted(r.text for r in evaluate.labelled(docs, labels).collect()) == ["a", "b"]


def by_steps(text):
    """N1-N3 one after the other."""
    return T.fold_confusables(T.fold_unicode(T.strip_invisible(text)))


def test_folding_at_once_is_folding_step_by_step(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = [(f"A{c}b {c}",) for c in chars] + [("ΟΔΟΣ ΆΣ Σ’α İÍ ​х",), (None,), ("",)]
    df = spark.createDataFrame(rows, "text string")
    assert df.filter(~T.fold_characters(F.col("text")).eqNullSafe(by_steps(F.col("text")))).collect() == []


def test_signs_for_letters_at_once(spark):
    given = ["y0u @re 1 2 10 100 $$ a$ $a ($) 5 | x€ 7- -7 €", "3", "", None, "0 0", "é0 0é ш3", "2024!", "x+ +", "((("]
    symbols = set(T.LEET)

    def told(s):
        if s is None:
            return None
        near = lambda i: 0 <= i < len(s) and (s[i].isalpha() or s[i] in symbols)
        return "".join(T.LEET[c] if c in symbols and (near(i - 1) or near(i + 1)) else c for i, c in enumerate(s))

    df = spark.createDataFrame([(s,) for s in given], "text string").select("text", T.fold_leet(F.col("text")).alias("f"))
    assert {r.text: r.f for r in df.collect()} == {s: told(s) for s in given}


def test_a_word_the_lexicon_knows_stays(spark):
    typos = {"idito": "idiot", "stupdi": "stupid", "hell": "help"}
    words_ = ["idito", "hell", "looooser", "loser", "aa", "ass", "asss", "u", "ur", "bookk", "stupdi", None, ""]
    df = spark.createDataFrame([(w,) for w in words_], "token string")
    known = set(normalize.vocabulary()) | set(L.ALIASES)

    def canonical(w):
        import re
        name = lambda x: L.ALIASES.get(x, x) if x in known else None
        if w is None or name(w) or len(w) <= 2:
            return w and (name(w) or w)
        if w in typos:
            return typos[w]
        two, one = re.sub(r"(.)\1{2,}", r"\1\1", w), re.sub(r"(.)\1+", r"\1", w)
        return (two != w and name(two)) or name(one) or w

    got = {r.token: r.canonical for r in normalize.canonicalize(df, typos).collect()}
    assert got == {w: canonical(w) for w in words_}


def test_texts_without_a_scoring_word_score_nothing(spark):
    """Whatever the tiers give a score to has a word they are let through by."""
    lines = [*frames.CARRIERS, *[p for ps in phrases.PHRASE_LISTS.values() for p in ps], *tier0.scoring_words(), "k y s", "you i d i o t", "fine day", "", None]
    df = spark.createDataFrame([(i, t, f"{t} today" if t else t) for i, t in enumerate(lines)], "id long, a string, b string")
    for text in ("a", "b"):
        judged = cascade.moderate(normalize.normalize(df, text).withColumn("may", F.expr(tier0.may_score())), text, keep=["id", text, "may"])
        rows = judged.collect()
        assert [r[text] for r in rows if r.score > 0 and not r.may] == [] and any(r.may is False for r in rows)
        held = {r.id: r.score for r in cascade.held_of(df, text, "attentive").collect()}
        assert held == {r.id: r.score for r in judged.filter(cascade.held("attentive")).collect()} and held


def test_offers_look_for_distress_first(spark, monkeypatch):
    monkeypatch.setattr(streams, "once", lambda df, keys, ts, delay: df.dropDuplicates(keys))  # a batch has no watermark
    rows = [(1, "i want to die"), (2, "I WANT to die!!"), (3, "nice day"), (4, None), (5, "i hate myself")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("ts", F.timestamp_seconds("id"))
    whole = cascade.moderate(normalize.normalize(df)).filter("distress").dropDuplicates(["squashed"])
    got = streams.offer_once(df)
    assert set(got.columns) == set(whole.columns)
    assert {r.squashed: (r.score, r.level) for r in got.collect()} == {r.squashed: (r.score, r.level) for r in whole.collect()} and got.count() == 2
