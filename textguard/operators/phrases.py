"""Word and phrase lists matched against normalised text.

Each operator adds columns to a normalised frame. One pass over the words keeps the few that
any list knows (``found``); everything after that looks at this short array, so a text with
no interesting word costs one hash lookup per word and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard import lexicon as L
from textguard.functions.arrays import any_in, common, n_common, quote, words

PHRASE_LISTS = {
    "explicit_phrase": L.EXPLICIT_PHRASES, "exclusion": L.EXCLUSION_PHRASES,
    "backhanded": L.BACKHANDED_PHRASES, "pointed": L.POINTED_BACKHANDED, "mockery": L.MOCKERY_PHRASES,
    "self_harm": L.SELF_HARM_PHRASES, "distress": L.DISTRESS_PHRASES, "sarcasm": L.SARCASM_MARKERS,
    "veiled": L.VEILED_MARKERS,
}
# Lists also looked up in the form where spelled-out letters are glued back together.
EVASIVE = {"explicit_phrase", "self_harm"}
PRONOUNS = ["he", "she", "him", "her", "hes", "shes", "they", "them"]

WORD_LISTS = {
    "second_person": L.SECOND_PERSON, "first_person": L.FIRST_PERSON, "slur": L.SLURS,
    "soft_slur": L.SOFT_SLURS, "insult_noun": L.INSULT_NOUNS, "person_insult": L.PERSON_INSULTS,
    "insult_adjective": L.INSULT_ADJECTIVES, "mild_insult": L.MILD_INSULTS, "degrading": L.DEGRADING_WORDS,
    "strong_profanity": L.STRONG_PROFANITY, "mild_profanity": L.MILD_PROFANITY, "explicit": L.EXPLICIT_WORDS,
}


def lexicon_rows() -> list[tuple[str, str, str]]:
    """Every (term, list, kind), once each."""
    lists = [(name, terms, "word") for name, terms in WORD_LISTS.items()]
    lists += [("excluded_app", L.EXCLUDED_APPS, "app")]
    phrases = {**PHRASE_LISTS, "lethal": L.LETHAL_DIRECTIVES, "threat": L.THREAT_PHRASES, "negator": L.NEGATORS}
    lists += [(name, terms, "phrase") for name, terms in phrases.items()]
    return [(t, name, kind) for name, terms, kind in lists for t in dict.fromkeys(terms)]


def lexicon_table(spark: SparkSession) -> DataFrame:
    """L1: the word and phrase lists as one dimension (term, list, kind); under 1,000 rows."""
    return spark.createDataFrame(lexicon_rows(), "term string, list string, kind string")


def needle(phrase: str) -> str:
    """A phrase as it appears in padded text."""
    return f" {phrase.replace(chr(39), '')} "


def trigger(phrase: str) -> str:
    """The phrase's longest word: without it the phrase cannot be there."""
    return max(needle(phrase).split(), key=lambda w: (len(w), w))


def interesting_words() -> list[str]:
    """Every word that any list, phrase or score looks at."""
    found = {w for terms in WORD_LISTS.values() for w in terms}
    found |= set(L.AIM_SECOND) | set(L.AIM_FIRST) | set(L.EVALUATIVE_WORDS) | set(PRONOUNS) | {"your", "laude"}
    found |= {trigger(p) for terms in PHRASE_LISTS.values() for p in terms}
    return sorted(found)


def with_found(df: DataFrame) -> DataFrame:
    """Adds ``found`` (listed words of the text) and, where the frame has ``ctext`` and ``cjoined``, ``found_all`` (with glued letters too)."""
    both = "concat(canonical, split(trim(cjoined), ' '))"
    df = df.withColumn("found", F.expr(common("canonical", interesting_words())))
    return df if "cjoined" not in df.columns else df.withColumn(
        "found_all", F.expr(f"CASE WHEN cjoined = ctext THEN found ELSE {common(both, interesting_words())} END"))


def phrase_list_hits(name: str) -> str:
    """The phrases of one list that occur as whole words, as an array expression.

    Spellings that normalise alike ("don't", "dont") each count, as does a phrase listed twice.
    """
    entries = ", ".join(f"struct({quote(p)} AS phrase, {quote(needle(p))} AS needle, {quote(trigger(p))} AS trigger)"
                        for p in PHRASE_LISTS[name])
    there = "contains(ctext, p.needle)"
    if name in EVASIVE:
        there = f"({there} OR contains(cjoined, p.needle))"
    triggers = sorted({trigger(p) for p in PHRASE_LISTS[name]})
    hits = f"filter(array({entries}), p -> array_contains(found_all, p.trigger) AND {there}).phrase"
    return f"CASE WHEN {any_in('found_all', triggers)} THEN {hits} ELSE cast(array() AS array<string>) END"


def phrase_hits(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """L3: adds ``<list>_hits`` for each phrase list."""
    for name in names or list(PHRASE_LISTS):
        df = df.withColumn(f"{name}_hits", F.expr(phrase_list_hits(name)))
    return df


def word_hits(df: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """L2: one row per (text, list, term) for every listed word in a text.

    The lexicon may be any table of (list, kind, term): the distinct words of each text meet it in a join, and whether it is small
    enough to be broadcast is left to Spark.
    """
    terms = lexicon.filter("kind = 'word'").select("term", "list").distinct()
    hits = df.select(key, F.explode(F.array_distinct("canonical")).alias("term"))
    return hits.join(terms, "term").select(key, "list", "term")


def content_score(df: DataFrame) -> DataFrame:
    """L4: swearing and explicit language by word: content_score, content_category, content_hits."""
    df = df.withColumn("explicit_words", F.expr(
        f"array_sort(CASE WHEN array_contains(found_all, 'laude') THEN array_remove({common('found_all', L.EXPLICIT_WORDS)}, 'cum')"
        f" ELSE {common('found_all', L.EXPLICIT_WORDS)} END)"))
    df = df.withColumn("strong_words", F.expr(f"array_sort({common('found_all', L.STRONG_PROFANITY)})"))
    df = df.withColumn("mild_words", F.expr(f"array_sort({common('found_all', L.MILD_PROFANITY)})"))
    explicit = "size(explicit_words) + size(explicit_phrase_hits) > 0"
    return df.withColumns({
        "content_score": F.expr(f"CASE WHEN {explicit} THEN 0.97e0 WHEN size(strong_words) > 0 THEN 0.86e0"
                                " WHEN size(mild_words) > 0 THEN 0.66e0 ELSE 0e0 END"),
        "content_category": F.expr(f"CASE WHEN {explicit} THEN 'explicit'"
                                   " WHEN size(strong_words) + size(mild_words) > 0 THEN 'profanity' END"),
        "content_hits": F.expr(
            f"CASE WHEN {explicit} THEN transform(slice(concat(explicit_words, explicit_phrase_hits), 1, 3), w -> concat('explicit:', w))"
            " WHEN size(strong_words) > 0 THEN transform(slice(strong_words, 1, 3), w -> concat('profanity:', w))"
            " ELSE transform(slice(mild_words, 1, 3), w -> concat('profanity-mild:', w)) END"),
    }).drop("explicit_words", "strong_words", "mild_words")


def addressing(df: DataFrame) -> DataFrame:
    """Adds ``second`` (somebody is spoken to) and ``first`` (the writer speaks of themselves)."""
    return df.withColumns({
        "second": F.expr(any_in("found", [*L.AIM_SECOND, "your"])),
        "first": F.expr(any_in("found", L.AIM_FIRST)),
    })


def slur_score(df: DataFrame) -> DataFrame:
    """slur_words and slur_score."""
    df = df.withColumn("slur_words", F.expr(f"array_sort({common('found_all', L.SLURS)})"))
    soft = f"size(array_except(slur_words, {words(L.SOFT_SLURS)})) = 0"
    return df.withColumn("slur_score", F.expr(
        f"CASE WHEN size(slur_words) = 0 THEN 0e0 WHEN {soft} THEN if(second, 0.72e0, 0.30e0)"
        " ELSE if(second, 0.95e0, 0.86e0) END"))


def distress_hits(df: DataFrame) -> DataFrame:
    """Distress (present or not) and up to two phrases that say so."""
    return df.withColumns({
        "distress": F.expr("size(self_harm_hits) + size(distress_hits) > 0"),
        "distress_marks": F.expr("slice(if(size(self_harm_hits) > 0, self_harm_hits, distress_hits), 1, 2)"),
    })


def exclusion_score(df: DataFrame) -> DataFrame:
    """Shutting somebody out. "... asked me/to/about ..." is no exclusion."""
    asked = "ctext RLIKE ' asked (?:me|us|him|her|them|to|for|about) '"
    df = df.withColumn("exclusion_hits", F.expr(f"filter(exclusion_hits, p -> NOT (endswith(p, 'asked') AND {asked}))"))
    return df.withColumn("exclusion_score", F.expr(
        "CASE WHEN size(exclusion_hits) = 0 THEN 0e0 ELSE least(0.55e0 + 0.08e0 * least(size(exclusion_hits) - 1, 2)"
        " + if(second, 0.07e0, 0e0), 0.80e0) END"))


def backhanded_score(df: DataFrame) -> DataFrame:
    """Praise with a barb."""
    return df.withColumn("backhanded_score", F.expr(
        "CASE WHEN size(pointed_hits) = 0 THEN 0e0"
        " ELSE least(0.48e0 + 0.08e0 * least(size(pointed_hits) - 1, 2), 0.64e0) END"))


def mockery_score(df: DataFrame) -> DataFrame:
    """Mockery."""
    return df.withColumn("mockery_score", F.expr(
        "CASE WHEN size(mockery_hits) = 0 THEN 0e0"
        " ELSE least(0.36e0 + 0.08e0 * least(size(mockery_hits) - 1, 3), 0.6e0) END"))


def lexical_fallback_score(df: DataFrame, out: str = "model_score") -> DataFrame:
    """The stand-in for a trained model, from word counts alone. Needs ``word_set``."""
    raw = (f"(0.30e0 * least({n_common('listed', L.DEGRADING_WORDS)}, 3)"
           f" + 0.18e0 * least({n_common('listed', L.STRONG_PROFANITY + L.MILD_PROFANITY)}, 3)"
           f" + 0.45e0 * least({n_common('listed', L.SLURS)}, 2))"
           f" * if({any_in('listed', L.SECOND_PERSON)}, 1.5e0, 0.6e0)")
    listed = common("word_set", [*L.DEGRADING_WORDS, *L.STRONG_PROFANITY, *L.MILD_PROFANITY, *L.SLURS, *L.SECOND_PERSON])
    return df.withColumn("listed", F.expr(listed)).withColumn(
        out, F.expr(f"CASE WHEN size(listed) = 0 THEN 0e0 ELSE least({raw}, 0.99e0) END")).drop("listed")


