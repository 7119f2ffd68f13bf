"""The rule tier's verdict (R9-R11, F16): one map-only pass over normalised messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard import lexicon as L
from textguard.functions.arrays import any_in, settle, within
from textguard.operators import aim, phrases, rules
from textguard.operators.normalize import normalize

LEVEL_NAMES = ["clear", "borderline", "harmful"]


def level_of(score: str) -> str:
    """F1: clear below 0.35, borderline below 0.70, harmful from there."""
    return f"CASE WHEN {score} >= 0.70e0 THEN 'harmful' WHEN {score} >= 0.35e0 THEN 'borderline' ELSE 'clear' END"


def long_tokens(tokens: str = "tokens") -> str:
    """The distinct words of more than two letters; what two messages are compared by."""
    return f"array_distinct(filter({tokens}, w -> char_length(w) > 2))"


def pile_on_score(df: DataFrame) -> DataFrame:
    """Two or more of the last six messages share nearly half their words with this one.

    Needs ``context_words``: an array, oldest first, of the earlier messages' word arrays.
    """
    own = long_tokens()
    df = df.withColumn("own_words", F.expr(own))
    alike = "size(c) > 0 AND size(array_intersect(own_words, c)) / size(array_union(own_words, c)) >= 0.45e0"
    recent = "slice(context_words, greatest(size(context_words) - 5, 1), 6)"
    df = df.withColumn("echoes", F.expr(
        f"CASE WHEN size(context_words) >= 2 AND size(own_words) > 0 THEN size(filter({recent}, c -> {alike})) ELSE 0 END"))
    return df.withColumn("pile_on_score", F.expr(
        "CASE WHEN echoes >= 2 THEN least(0.58e0 + 0.10e0 * echoes, 0.82e0) ELSE 0e0 END")).drop("own_words")


#: What the rule tier and the lexical score read of a normalised message.
WORDED = ["plain", "destretched", "tokens", "canonical", "ctext", "cjoined"]
# Lists of phrases that score; the others only mark a text.
SCORED_PHRASES = ["explicit_phrase", "exclusion", "pointed", "mockery"]


def scoring_words() -> list[str]:
    """Every word that a score can start from: without one of them, and without context, a message scores 0."""
    found = {*aim.INSULTS, *aim.PROFANITY, *L.SLURS, *L.EXPLICIT_WORDS, *rules.COMMANDS}
    found |= {w for ws in rules.triggers().values() for w in ws}
    return sorted(found | {phrases.trigger(p) for name in SCORED_PHRASES for p in phrases.PHRASE_LISTS[name]})


def may_score() -> str:
    """Whether a normalised message has such a word, in either form, as an expression. A null text is left to the tier."""
    there = any_in("canonical", scoring_words())
    return f"coalesce({there} OR (cjoined != ctext AND {any_in('split(cjoined, chr(32))', scoring_words())}), true)"


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """All signals of a normalised frame that need no context, each from its own operator.

    They are per-row, so they belong before the shuffle that brings the context.
    """
    df = phrases.with_found(df)
    df = phrases.addressing(df)
    df = phrases.phrase_hits(df)
    df = phrases.distress_hits(df)
    df = phrases.slur_score(df)
    df = phrases.content_score(df)
    df = phrases.exclusion_score(df)
    df = phrases.backhanded_score(df)
    df = phrases.mockery_score(df)
    df = rules.rule_hits(df)
    df = rules.bare_command(df)
    df = rules.quoting(df)
    df = rules.affection(df, text)
    df = aim.insult_aim(df)
    df = aim.insult_only(df)
    df = aim.insult_score(df)
    return settle(df)


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """All signals, those of the context included."""
    return settle(pile_on_score(df if "rules" in df.columns else signals(df, text)))


def affection_softener(df: DataFrame) -> DataFrame:
    """Teasing between friends softens a plain insult, never a rule's catch."""
    df = df.withColumn("affectionate", F.expr("soft_raw >= 0.45e0 AND size(rules) = 0 AND NOT bare_command AND affection"))
    return df.withColumn("soft", F.expr("if(affectionate, greatest(soft_raw - 0.30e0, 0.3e0), soft_raw)"))


def quote_damping(df: DataFrame) -> DataFrame:
    """Quoting cruelty pulls the score down, but never below what a banned word earns."""
    df = df.withColumn("quoted", F.expr("quoting AND greatest(hard, soft) > 0"))
    return df.withColumn("score", F.expr("greatest(if(quoted, greatest(hard, soft) * 0.4e0, greatest(hard, soft)), content_score)"))


def ambiguity_score(df: DataFrame) -> DataFrame:
    """How odd the shape of the text is; zero once the score speaks for itself, and for a text without words."""
    judging = f"size(filter(canonical, w -> {within('w', L.EVALUATIVE_WORDS)}))"
    parts = [
        "if(second, 0.22e0, 0e0)",
        "least(0.30e0, 0.16e0 * size(sarcasm_hits))",
        f"least(0.22e0, 0.12e0 * {judging})",
        "if(size(pointed_hits) + size(backhanded_hits) > 0, 0.30e0, 0e0)",
        "if(size(exclusion_hits) > 0, 0.18e0, 0e0)",
        "if(size(mockery_hits) > 0, 0.18e0, 0e0)",
        "least(0.40e0, 0.22e0 * size(veiled_hits))",
        "if(context_size > 0, 0.08e0, 0e0)",
        "if(context_size >= 2, 0.06e0, 0e0)",
        "if(endswith(plain, '...') OR contains(plain, ' lol'), 0.10e0, 0e0)",
    ]
    return df.withColumn("ambiguity", F.expr(f"CASE WHEN size(canonical) = 0 OR score >= 0.85e0 THEN 0e0 ELSE least({' + '.join(parts)}, 1e0) END"))


def trivial_gate(df: DataFrame) -> DataFrame:
    """F16: the rules saw nothing at all."""
    return df.withColumn("trivial", F.expr(
        "score < 0.2e0 AND size(hits) = 0 AND NOT second AND ambiguity < 0.15e0 AND size(canonical) <= 40 AND NOT addressed"))


def self_directed(df: DataFrame) -> DataFrame:
    """The writer's own pain is never scored as harm to others."""
    df = df.withColumn("self_directed", F.expr("distress AND first AND NOT second"))
    return df.withColumn("own_pain", F.expr(
        "self_directed AND NOT arrays_overlap(categories, array('threat', 'slur', 'explicit'))"))


def compose(df: DataFrame) -> DataFrame:
    """The verdict from the signals."""
    df = df.withColumns({
        "hard": F.expr("greatest(coalesce(array_max(filter(rules, r -> r.hard).score), 0e0),"
                       " if(bare_command, 0.92e0, 0e0), slur_score)"),
        "soft_raw": F.expr("greatest(coalesce(array_max(filter(rules, r -> NOT r.hard).score), 0e0), insult_score,"
                           " exclusion_score, backhanded_score, mockery_score, pile_on_score)"),
        "categories": F.expr("""array_sort(array_distinct(concat(
            flatten(rules.categories),
            if(bare_command, array('harassment', 'threat'), cast(array() AS array<string>)),
            array_compact(array(
                if(size(slur_words) > 0, 'slur', null),
                if(strong_n + mild_n + third_n > 0, 'insult', null),
                content_category,
                if(size(exclusion_hits) > 0, 'exclusion', null),
                if(size(pointed_hits) > 0, 'backhanded', null),
                if(size(mockery_hits) > 0, 'sarcasm', null),
                if(pile_on_score > 0, 'pileOn', null))))))"""),
        "addressed": F.expr("second OR size(rules) > 0 OR bare_command OR insult_aimed"),
    })
    df = affection_softener(df)
    df = quote_damping(df)
    df = df.withColumns({
        "hits": F.expr("""concat(
            if(bare_command, array('rule:bare command'), cast(array() AS array<string>)),
            rules.hit,
            transform(slur_words, w -> concat('slur:', w)),
            insult_hits,
            content_hits,
            transform(exclusion_hits, p -> concat('exclusion:', p)),
            transform(pointed_hits, p -> concat('backhanded:', p)),
            transform(mockery_hits, p -> concat('mockery:', p)),
            array_compact(array(
                if(pile_on_score > 0, 'pile-on:context', null),
                if(affectionate, 'affectionate', null),
                if(quoted, 'quoted', null))))"""),
        "sure": F.expr("""greatest(0.45e0,
            coalesce(array_max(transform(rules, r -> least(0.97e0, r.score))), 0e0),
            if(size(slur_words) > 0, 0.9e0, 0e0),
            if(insult_score >= 0.5e0, 0.8e0, 0e0),
            if(content_score > 0, 0.95e0, 0e0),
            if(size(exclusion_hits) > 0, 0.6e0, 0e0),
            if(pile_on_score > 0, 0.70e0, 0e0))"""),
    })
    df = ambiguity_score(df)
    df = trivial_gate(df)
    df = self_directed(df)
    df = df.withColumns({
        "score": F.expr("if(own_pain, least(score, 0.15e0), score)"),
        "confidence": F.expr("CASE WHEN size(canonical) = 0 THEN 1e0 WHEN own_pain THEN 0.9e0"
                             " WHEN quoted THEN least(sure, 0.5e0) ELSE sure END"),
        "hits": F.expr("concat(hits, if(own_pain, array('self-directed'), cast(array() AS array<string>)),"
                       " transform(distress_marks, p -> concat('distress:', p)))"),
        "tier": F.lit("rules"),
    })
    return df.withColumn("level", F.expr(level_of("score")))


VERDICT = ["score", "level", "confidence", "tier", "categories", "hits", "ambiguity", "trivial", "addressed",
           "distress", "self_directed", "affectionate", "quoted"]


def tier0_verdict(df: DataFrame, text: str = "text", typos: dict[str, str] | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """R11 over messages: normalise, read the signals, compose the verdict.

    ``context`` is optional on the input: ``context_size`` and ``context_words`` columns, as
    :func:`textguard.operators.context.with_context` adds them. Without them there is none.
    """
    given = keep or df.columns
    if "context_words" not in df.columns:
        df = df.withColumns({"context_size": F.lit(0), "context_words": F.expr("cast(array() AS array<array<string>>)")})
    if "canonical" not in df.columns:
        df = normalize(df, text, typos, keep=WORDED)
    kept = [c for c in given if c not in VERDICT]
    extra = [c for c in ("plain", "tokens", "destretched") if c not in kept]
    return settle(compose(features(df, text)).select(*kept, *extra, *VERDICT))
