"""Who an insult lands on.

The walk from an insult back to its subject never leaves the message and looks at seven words
at most, so it is a per-row expression: no explode, no self-join, no regrouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard import lexicon as L
from textguard.functions.arrays import any_in, let, quote, within
from textguard.operators.phrases import PRONOUNS

INSULTS = [*L.INSULT_NOUNS, *L.INSULT_ADJECTIVES]
PROFANITY = [*L.STRONG_PROFANITY, *L.MILD_PROFANITY]
POSSESSIVES = ["your", "ur", "yo"]
WARM_EMOJI = ["\U0001F602", "\U0001F923", "\U0001F62D", "❤", "\U0001F970"]
STEPS = 7


def subject_of(word: str, j: str, i: str, t: str = "canonical") -> str:
    """What the word at ``j`` says about an insult at ``i``: an aim, 'stop', or null to walk on."""
    before = f"get({t}, {j} - 2)"
    after = f"get({t}, {i})"
    about_a_thing = (f"{word} = 'your' AND {i} - {j} <= 2 AND {within(f'get({t}, {i} - 1)', L.INSULT_ADJECTIVES)}"
                     f" AND {after} IS NOT NULL AND NOT {within(after, [*INSULTS, *PROFANITY, *L.FUNCTION_WORDS])}")
    owned = f"coalesce({within(before, POSSESSIVES)}, false)"
    return f"""CASE
        WHEN {within(word, L.NEGATIONS)} THEN 'none'
        WHEN {within(word, POSSESSIVES)} THEN if({about_a_thing}, 'none', 'second')
        WHEN {within(word, L.AIM_SECOND)} THEN 'second'
        WHEN {within(word, L.BODY_WORDS)} AND {owned} THEN 'family'
        WHEN {within(word, L.FAMILY_WORDS)} THEN if({owned}, 'family', 'third')
        WHEN {within(word, L.AIM_FIRST)} THEN 'first'
        WHEN {within(word, L.AIM_THIRD)} THEN 'third'
        WHEN {within(word, ['what', 'such', 'how'])} THEN 'vocative'
        WHEN NOT {within(word, [*L.FILLER_WORDS, *INSULTS, *PROFANITY])} THEN 'stop' END"""


def insult_aim(df: DataFrame) -> DataFrame:
    """Adds ``aims``, an array of (pos, word, aim) with one entry per insult word.

    ``aim`` is where the walk ended: second, family, third, first, vocative or none.
    """
    where = f"filter(transform(canonical, (w, k) -> if({within('w', INSULTS)}, k + 1, 0)), k -> k > 0)"
    steps = (f"filter(transform(if(i > 1, sequence(i - 1, greatest(i - {STEPS}, 1), -1), cast(array() AS array<int>)),"
             f" j -> {let('get(canonical, j - 1)', 's', subject_of('s', 'j', 'i'))}), c -> c IS NOT NULL)")
    beyond = f"""CASE
        WHEN {within('get(canonical, i)', L.AIM_SECOND)} THEN 'second'
        WHEN i = size(canonical) AND i > 1 AND {within('get(canonical, i - 1)', L.PERSON_INSULTS)} THEN 'vocative'
        ELSE 'none' END"""
    aim = let(f"coalesce(get({steps}, 0), 'stop')", "c", f"if(c = 'stop', {beyond}, c)")
    aims = f"transform({where}, i -> struct(i AS pos, get(canonical, i - 1) AS word, {aim} AS aim))"
    empty = "cast(array() AS array<struct<pos:int,word:string,aim:string>>)"
    return df.withColumn("aims", F.expr(f"CASE WHEN {any_in('found', INSULTS)} THEN {aims} ELSE {empty} END"))


def insult_only(df: DataFrame) -> DataFrame:
    """Up to six words, all of them insults, swearing, slurs or padding."""
    allowed = [*INSULTS, *PROFANITY, *L.INSULT_ONLY_FILLERS, *L.SLURS]
    return df.withColumn("insult_only", F.expr(
        f"size(canonical) BETWEEN 1 AND 6 AND forall(canonical, w -> {within('w', allowed)})"))


def insult_score(df: DataFrame) -> DataFrame:
    """insult_score, insult_hits, insult_aimed. Needs aims, insult_only, first and second."""
    df = df.withColumn("third_person", F.expr(any_in("found", PRONOUNS)))
    settled = """CASE
        WHEN a.aim = 'vocative' AND first AND NOT second THEN 'first'
        WHEN a.aim = 'vocative' AND third_person AND NOT second THEN 'third'
        WHEN a.aim = 'vocative' THEN 'second'
        WHEN a.aim = 'none' AND insult_only AND NOT first THEN 'second'
        ELSE a.aim END"""
    mild = within("a.word", L.MILD_INSULTS)
    df = df.withColumn("landed", F.expr(
        f"transform(aims, a -> struct(a.word AS word, {settled} AS aim, {mild} AS mild))"))
    direct = within("a.aim", ["second", "family"])
    warm = " OR ".join([f"contains(ctext, {quote(m)})" for m in L.WARM_MARKERS]
                       + [f"contains(plain, {quote(e)})" for e in WARM_EMOJI])
    df = df.withColumns({
        "strong_n": F.expr(f"size(filter(landed, a -> {direct} AND NOT a.mild))"),
        "mild_n": F.expr(f"size(filter(landed, a -> {direct} AND a.mild))"),
        "third_n": F.expr("size(filter(landed, a -> a.aim = 'third'))"),
        "third_strong": F.expr("exists(landed, a -> a.aim = 'third' AND NOT a.mild)"),
        "warm": F.expr(warm),
    })
    aimed = """CASE
        WHEN strong_n > 0 THEN least(0.80e0 + least(strong_n + mild_n - 1, 2) * 0.06e0, 0.92e0)
        WHEN mild_n > 0 THEN least(if(warm, 0.50e0, 0.63e0) + least(mild_n - 1, 2) * 0.06e0, if(warm, 0.6e0, 0.72e0))
        ELSE 0e0 END"""
    df = df.withColumn("insult_score", F.expr(
        f"""CASE WHEN size(landed) = 0 THEN 0e0
            ELSE greatest({aimed}, CASE WHEN third_n = 0 THEN 0e0 WHEN third_strong THEN 0.64e0 ELSE 0.40e0 END,
                 if(strong_n + mild_n + third_n = 0, 0.15e0, 0e0)) END"""))
    label = """CASE WHEN a.aim IN ('second', 'family') THEN if(a.mild, 'insult-mild:', 'insult:')
        WHEN a.aim = 'third' THEN 'third:' ELSE 'unaimed:' END"""
    df = df.withColumns({
        "insult_hits": F.expr(f"transform(landed, a -> concat({label}, a.word))"),
        "insult_aimed": F.expr("strong_n + mild_n > 0 OR (insult_only AND NOT first)"),
    })
    return df.drop("third_person", "landed", "third_strong", "warm")
