"""Whole-word pattern rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard import lexicon as L
from textguard import rulebook as B
from textguard.functions.arrays import any_in, common, quote, within, words

# Words that make the writer the subject of what follows.
WRITER_BEFORE = [*L.AIM_FIRST, "we", "could"]


def fill(pattern: str) -> str:
    """A rule's pattern with its templates filled in."""
    insult = "(?:" + "|".join(L.INSULT_ADJECTIVES + L.INSULT_NOUNS) + ")"
    slots = {"{Y}": B.YOU, "{YR}": B.YOU_ARE, "{YS}": B.YOURSELF, "{T}": B.TARGET, "{ME}": B.WRITER, "{INSULT}": insult}
    for slot, value in slots.items():
        pattern = pattern.replace(slot, value)
    return pattern


# Look-behinds need a bound on the words they step over. Longer words are cut to it first: no name is as long, so it stays no name.
STEP = 40


def not_after(names: list[str], depth: int) -> str:
    """Look-behinds: none of the last ``depth`` words is one of the names. For texts as :func:`stepped` gives them."""
    group = "(?:" + "|".join(names) + ")"
    assert max(map(len, names)) < STEP
    return "".join(f"(?<! {group} {f'[^ ]{{1,{STEP}}} ' * i})" for i in range(depth))


def stepped(text: str) -> str:
    """The text with words of more than ``STEP`` characters cut to that length."""
    long = f"[^ ]{{{STEP + 1}}}"
    return f"if({text} RLIKE {quote(long)}, regexp_replace({text}, {quote(f'([^ ]{{{STEP}}})[^ ]+')}, '$1'), {text})"


def whole_words(pattern: str, guard: str = "") -> str:
    """The pattern as whole words. Look-behinds are dear, so a guard is asked only where the pattern is."""
    return f"(?<= )(?=(?:{pattern}) ){guard}" if guard else f"(?<= )(?:{pattern})(?= )"


def rule_patterns() -> list[tuple[str, str, float, list[str], str, bool]]:
    """(kind, name, score, categories, pattern, guarded); hard rules are 'rule', soft ones 'phrase'."""
    return [("phrase" if family == "harassment" else "rule", name, score, categories,
             whole_words(fill(pattern), not_after(WRITER_BEFORE, 3) if guarded else ""), guarded)
            for family, name, score, categories, pattern, guarded in B.RULES]


def triggers() -> dict[str, list[str]]:
    """Rule -> words of which a text must have one for the rule to match."""
    return {name: listed.split() for name, listed in B.TRIGGERS.items()}


def rule_hits(df: DataFrame) -> DataFrame:
    """Adds ``rules``, an array of (hit, hard, score, categories) in rule order.

    Both forms of the text are read; the glued one only where it differs. A pattern runs where one of the rule's trigger words is in the text.
    """
    known, cases = triggers(), []
    both = "if(cjoined = ctext, canonical, concat(canonical, split(trim(cjoined), ' ')))"
    df = df.withColumn("_triggers", F.expr(common(both, sorted({w for ws in known.values() for w in ws}))))
    for kind, name, score, categories, pattern, guarded in rule_patterns():
        plain, glued = (stepped("ctext"), stepped("cjoined")) if guarded else ("ctext", "cjoined")
        found = f"{plain} RLIKE {quote(pattern)} OR (cjoined != ctext AND {glued} RLIKE {quote(pattern)})"
        cases.append(f"CASE WHEN {any_in('_triggers', known[name])} AND ({found}) THEN struct({quote(f'{kind}:{name}')} AS hit, {'true' if kind == 'rule' else 'false'} AS hard, "
                     f"{score}e0 AS score, {words(categories)} AS categories) END")
    empty = "cast(array() AS array<struct<hit:string,hard:boolean,score:double,categories:array<string>>>)"
    found = f"CASE WHEN size(_triggers) > 0 THEN array_compact(array({', '.join(cases)})) ELSE {empty} END"
    return df.withColumn("rules", F.expr(found)).drop("_triggers")


# Commands to die.
COMMANDS = ["die", "rot", "kys"]


def bare_command(df: DataFrame) -> DataFrame:
    """A command to die that is the whole message."""
    return df.withColumn("bare_command", F.expr(
        f"coalesce(size(canonical) <= 3 AND {within('get(canonical, 0)', COMMANDS)}, false)"))


def quoting(df: DataFrame) -> DataFrame:
    """R7, the test: the text reports or refuses cruelty."""
    pattern = whole_words("|".join(f"(?:{p})" for p in B.REPORTING))
    return df.withColumn("quoting", F.expr(f"{any_in('canonical', B.REPORTING_TRIGGERS.split())} AND ctext RLIKE {quote(pattern)}"))


def affection(df: DataFrame, text: str = "text") -> DataFrame:
    """R8, the test: a heart, or words of affection without a negation in the four words before."""
    plain, signs = ([f"contains({text}, {quote(e)})" for e in L.AFFECTION_EMOJI if e.isascii() == ascii] for ascii in (True, False))
    emoji = " OR ".join([*plain, f"(octet_length({text}) != char_length({text}) AND ({' OR '.join(signs)}))"])
    marks = whole_words(B.AFFECTION, not_after(L.LOVE_NEGATORS, 4))
    there = any_in("canonical", B.AFFECTION_TRIGGERS.split())  # rare, and far cheaper than the look-behinds
    return df.withColumn("affection", F.expr(f"({emoji}) OR ({there} AND {stepped('ctext')} RLIKE {quote(marks)})"))


def rule_table(df: DataFrame, key: str) -> DataFrame:
    """One row per (text, rule hit)."""
    return df.select(key, F.explode("rules").alias("r")).select(
        key, F.col("r.hit").alias("rule"), F.col("r.hard").alias("hard"), F.col("r.score").alias("score"),
        F.array_join("r.categories", ",").alias("categories"))
