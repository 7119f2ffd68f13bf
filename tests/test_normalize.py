from pyspark.sql import functions as F

from textguard.operators import normalize as N
from textguard.operators import phrases


def forms(spark, rows, typos=None):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    return {r.text: r for r in N.normalize(df, typos=typos).collect()}


def test_disguises_are_folded(spark):
    got = forms(spark, ["You're a l0ser!", "loser!", "room 101", "i have 4 tickets", "k.y.s now", "sh*t n****r",
                        "looooser cooool", "ÉTÉ ｆｕｃｋ", "a​b", "i a b d", "if you f u", "", "  \n "])
    assert got["You're a l0ser!"].plain == "you're a loseri"
    assert got["You're a l0ser!"].tokens == ["youre", "a", "loseri"]
    assert got["loser!"].plain == "loseri"  # an exclamation mark that touches a letter is an i
    assert got["room 101"].plain == "room ioi"  # digits touch each other
    assert got["i have 4 tickets"].plain == "i have 4 tickets"
    assert got["k.y.s now"].cjoined == " kys now "
    assert got["k.y.s now"].ctext == " k y s now "
    assert got["sh*t n****r"].canonical == ["shit", "nigger"]
    assert got["looooser cooool"].canonical == ["loser", "cooool"]
    assert got["ÉTÉ ｆｕｃｋ"].plain == "ete fuck"
    assert got["a​b"].plain == "ab"
    assert got["i a b d"].cjoined == " iabd "
    assert got["if you f u"].cjoined == " if you f u "
    assert got[""].canonical == [] and got["  \n "].ctext == "  "


def test_typos_need_a_dictionary(spark):
    words = spark.createDataFrame([("botch",), ("duck",)], "term string")
    typos = N.surviving_typos(spark, words)
    got = forms(spark, ["yourswlf botch botches moorn stuipd bitcy"], typos)["yourswlf botch botches moorn stuipd bitcy"]
    assert got.canonical == ["yourself", "botch", "botches", "moorn", "stupid", "bitcy"] or got.canonical[1] == "botch"
    assert "botch" not in typos and "yourswlf" in typos
    assert N.surviving_typos(spark, None)["botch"] == "bitch"


def test_real_words_by_inflection(spark):
    tokens = spark.createDataFrame([(w,) for w in ["stopping", "batted", "hoped", "zzz", "cats", "as"]], "token string")
    words = spark.createDataFrame([(w,) for w in ["stop", "bat", "hope", "cat"]], "term string")
    got = {r.token: r.is_real for r in N.is_real_word(tokens, words).collect()}
    assert got == {"stopping": True, "batted": True, "hoped": True, "zzz": False, "cats": True, "as": False}


def test_phrases_normalise_to_their_needles(spark):
    every = [p for name in phrases.PHRASE_LISTS for p in phrases.PHRASE_LISTS[name]]
    df = spark.createDataFrame([(p, phrases.needle(p)) for p in every], "text string, needle string")
    wrong = N.normalize(df).filter("ctext != needle").select("text", "ctext").collect()
    assert wrong == []


def test_passages_cover_the_whole_text(spark):
    text = " ".join(f"word{i}" for i in range(2000))
    df = spark.createDataFrame([(1, text), (2, "short")], "id int, text string")
    rows = N.passage_window(df).orderBy("id", "passage").collect()
    assert [r.passage_text for r in rows if r.id == 2] == ["short"]
    seen = set()
    for r in rows:
        if r.id == 1:
            seen |= set(r.passage_text.split())
            assert len(r.passage_text) <= 1500
    assert {f"word{i}" for i in range(2000)} <= seen


def test_typo_forms_by_brute_force():
    near = N.adjacency()
    for slip, word in list(N.typo_forms().items())[::97]:
        diff = [i for i in range(len(word)) if slip[i] != word[i]]
        assert len(slip) == len(word) and slip[0] == word[0]
        one = len(diff) == 1 and slip[diff[0]] in near[word[diff[0]]]
        swap = len(diff) == 2 and diff[1] == diff[0] + 1 and slip[diff[0]] == word[diff[1]] and slip[diff[1]] == word[diff[0]]
        assert one or swap


def test_squash_is_the_key_of_a_text(spark):
    df = N.normalize(spark.createDataFrame([("k y s",), ("kk-yy-ss",)], "text string"))
    assert df.select("squashed").distinct().count() == 1
    assert df.select(F.first("squashed")).first()[0] == "kys"
