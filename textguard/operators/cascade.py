"""From the rule tier to a final verdict."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.functions.arrays import quote, same_key, settle
from textguard.operators.model_scorer import BatchScorer
from textguard.operators.normalize import normalize, word_forms
from textguard.operators.phrases import lexical_fallback_score
from textguard.operators.policy import held
from textguard.operators.tier0 import WORDED, level_of, may_score, tier0_verdict

DECISIVE = "0.85e0"
STRONG_OPINION = "0.90e0"

# What a refused rewrite says.
REFUSALS = [
    "i cannot", "i can't", "i can not", "i'm unable", "i am unable", "i won't", "i will not",
    "as an ai", "i am programmed", "i'm programmed", "language model", "i'm sorry, but",
    "i am sorry, but", "safety guidelines", "i'm not able", "i am not able", "cannot fulfill",
    "can't help with", "cannot help with", "harmful content", "against my",
]


class Scorer(Protocol):
    """Anything that adds ``model_score`` (0..1) to a frame of normalised messages."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def lexical_scorer(df: DataFrame) -> DataFrame:
    """The default scorer: L10."""
    return lexical_fallback_score(word_forms(df)).drop("word_set")


def model_confidence(score: str = "model_score", lexical: bool = True) -> str:
    """Distance from the fence; a lexical score is never more than half sure."""
    sure = f"least(1e0, abs({score} - 0.5e0) * 2e0)"
    return f"least({sure}, 0.5e0)" if lexical else sure


def tier1_score(df: DataFrame, scorer: Scorer = lexical_scorer, lexical: bool = True) -> DataFrame:
    """model_score, model_confidence, model_level and model_category of normalised messages."""
    return scorer(df).withColumns({
        "model_confidence": F.expr(model_confidence(lexical=lexical)),
        "model_level": F.expr(level_of("model_score")),
        "model_category": F.expr("if(model_score >= 0.5e0, 'insult', null)"),
    })


def local_verdict(verdicts: DataFrame, scorer: Scorer = lexical_scorer, transformer: bool = False,
                  reachable: bool = False, lexical: bool = True) -> DataFrame:
    """The rule tier's verdict with the model as a second opinion.

    Rows that are already decided never reach the scorer. A ``BatchScorer`` is told which rows to
    leave out. For any other the frame is split, and only the undecided part is scored. With the
    built-in scorer no Python runs, so no split is needed and one pass does both.
    """
    decided = f"(self_directed OR trivial OR score >= {DECISIVE})"
    if scorer is lexical_scorer:
        df = scorer(verdicts).withColumn("model_score", F.expr(f"if({decided}, 0e0, model_score)"))
    elif isinstance(scorer, BatchScorer):
        df = scorer(verdicts, f"NOT {decided}")
    else:
        skipped = verdicts.filter(decided).withColumn("model_score", F.lit(0.0))
        df = scorer(verdicts.filter(f"NOT {decided}")).unionByName(skipped)
    weak = "forall(hits, h -> h = 'phrase:shut up' OR startswith(h, 'profanity:'))"
    df = df.withColumns({
        "decided": F.expr(decided),
        "model_sure": F.expr(model_confidence(lexical=lexical)),
        "open": F.expr(f"NOT {decided} AND NOT affectionate AND NOT quoted AND addressed AND model_score >= {STRONG_OPINION}"),
        "weak_only": F.expr(weak),
    })
    if transformer:
        df = df.withColumns({"pushed": F.lit(False), "suspect": F.expr("open AND score < 0.62e0")})
    else:
        df = df.withColumns({
            "pushed": F.expr("open AND NOT weak_only AND score >= 0.35e0 AND score < 0.66e0"),
            "suspect": F.lit(False),
        })
    df = df.withColumns({
        "confidence": F.expr("CASE WHEN decided THEN confidence WHEN pushed THEN greatest(confidence, model_sure)"
                             " ELSE greatest(confidence, model_sure * 0.8e0) END"),
        "score": F.expr("if(pushed, 0.66e0, score)"),
        "tier": F.expr("if(pushed, 'on_device', tier)"),
        "categories": F.expr("if(pushed AND size(categories) = 0, array('insult'), categories)"),
        "pending": F.col("suspect") if reachable else F.lit(False),
    })
    if transformer and not reachable:
        df = offline_fallback(df, "suspect")
    df = df.withColumn("level", F.expr(level_of("score")))
    return settle(df.drop("decided", "model_sure", "open", "weak_only", "pushed", "suspect"))


def offline_fallback(df: DataFrame, waiting: str = "pending") -> DataFrame:
    """Nobody to ask; a model all but certain is believed up to 0.5."""
    sure = f"({waiting} AND model_score >= 0.98e0)"
    return df.withColumns({
        "tier": F.expr(f"if({sure}, 'on_device', tier)"),
        "categories": F.expr(f"if({sure} AND size(categories) = 0, array('insult'), categories)"),
        "score": F.expr(f"if({sure}, greatest(score, 0.5e0), score)"),
        "pending": F.expr(f"if({waiting}, false, pending)"),
    }).withColumn("level", F.expr(level_of("score")))


def escalation_gate(word_policy: str = "arrays_overlap(categories, array('profanity', 'explicit'))") -> str:
    """worth a reviewer's look, as an expression over a local verdict."""
    undecided = f"NOT self_directed AND NOT trivial AND score < {DECISIVE}"
    uncertain = f"(NOT {word_policy} AND score > 0.30e0 AND score < 0.80e0)"
    return f"({undecided} AND ({uncertain} OR ambiguity >= 0.42e0 OR pending OR (addressed AND model_score >= {STRONG_OPINION})))"


def merge_review(local: DataFrame, review: DataFrame, key: str) -> DataFrame:
    """C4: the reviewer wins, except over decisive local scores and banned words.

    ``review`` has one row per key: r_score, r_confidence, r_categories, r_rationale,
    r_self_directed and r_latency_ms.
    """
    banned = "arrays_overlap(categories, array('profanity', 'explicit'))"
    merged = local.join(review, key, "left").withColumn("reviewed", F.col("r_score").isNotNull())
    df = merged.withColumns({
        "score": F.expr(f"CASE WHEN NOT reviewed THEN score WHEN score >= {DECISIVE} OR {banned}"
                        " THEN greatest(r_score, score) ELSE r_score END"),
        "categories": F.expr(f"""CASE WHEN NOT reviewed OR size(r_categories) = 0 THEN categories
            WHEN {banned} THEN array_sort(array_union(r_categories, categories)) ELSE r_categories END"""),
        "confidence": F.expr("if(reviewed, r_confidence, confidence)"),
        "tier": F.expr("if(reviewed, 'context', tier)"),
        "rationale": F.expr("if(reviewed, r_rationale, null)"),
        "self_directed": F.expr("if(reviewed, r_self_directed, self_directed)"),
        "distress": F.expr("if(reviewed, r_self_directed, distress)"),
        # The reviewer has settled it: nothing waits, and the model's opinion no longer counts.
        "pending": F.expr("if(reviewed, false, pending)"),
        "model_score": F.expr("if(reviewed, 0e0, model_score)"),
        "latency_ms": F.expr("latency_ms + if(reviewed, r_latency_ms, 0e0)"),
    })
    return df.withColumn("level", F.expr(level_of("score"))).drop(
        "r_score", "r_confidence", "r_categories", "r_rationale", "r_self_directed", "r_latency_ms")


def cascade_route(local: DataFrame, review: DataFrame, key: str, allow_context: bool = True,
                  model_loaded: bool = False) -> DataFrame:
    """Who decided each message, and how: ``source`` beside the final verdict."""
    df = local.withColumns({
        "first_stop": F.expr(f"CASE WHEN self_directed THEN 'T0 self-directed' WHEN trivial THEN 'T0 clear'"
                             f" WHEN score >= {DECISIVE} THEN 'T0 decisive' END"),
        "asked": F.expr(escalation_gate()) if allow_context else F.lit(False),
    })
    asked = df.filter("asked").select(key).join(review, key)
    df = merge_review(df, asked, key)
    unanswered = "asked AND NOT reviewed AND pending" if allow_context else "false"
    df = df.withColumn("unanswered", F.expr(unanswered))
    df = offline_fallback(df, "unanswered")
    engine = "model" if model_loaded else "fallback"
    return df.withColumn("source", F.expr(
        f"CASE WHEN first_stop IS NOT NULL THEN first_stop WHEN reviewed THEN 'T2 reviewer'"
        f" WHEN asked THEN 'T1 (context unavailable)' ELSE 'T1 {engine}' END")).drop("first_stop", "unanswered")


def cached_verdict(df: DataFrame, key: str, text: str, score_fn: Callable[[DataFrame], DataFrame], salts: int = 32,
                   row_id: str | None = None) -> DataFrame:
    """Score each distinct ``key`` once and give every row its verdict.

    One text may make up a third of all rows. Rows are therefore spread over (key, salt): the
    distinct pairs are few (at most ``salts`` per key), they pick up the verdict of their key,
    and the join back is on the pair, so a hot text is shared out over ``salts`` tasks.
    """
    seed = F.col(row_id) if row_id else F.monotonically_increasing_id()
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(seed), F.lit(salts)).cast("int"))
    pairs = rows.groupBy(key, "_salt").agg(F.min(text).alias(text))
    once = score_fn(pairs.groupBy(key).agg(F.min(text).alias(text))).drop(text)
    verdicts = same_key(pairs.select(key, "_salt"), once, [key])
    return same_key(rows, verdicts, [key, "_salt"]).drop("_salt")


def moderate(df: DataFrame, text: str = "text", scorer: Scorer = lexical_scorer, keep: list[str] | None = None,
             typos: dict[str, str] | None = None) -> DataFrame:
    """Normalise, rule tier and local verdict in one go; map-only with the default scorer.

    ``typos`` (here and below) comes from :func:`textguard.operators.normalize.surviving_typos`; without it no typo is corrected.
    """
    return local_verdict(tier0_verdict(df, text, typos, keep), scorer)


def held_of(df: DataFrame, text: str, sensitivity: str, typos: dict[str, str] | None = None) -> DataFrame:
    """The rows of :func:`moderate` that are held, for texts without context.

    A text that scores 0 is held at no sensitivity, so the tiers read only those with a word that a score can start from.
    """
    worded = normalize(df, text, typos, keep=WORDED).filter(may_score())
    return moderate(worded, text, keep=df.columns, typos=typos).filter(held(sensitivity))


def fragments(text: str) -> str:
    """What of a text is judged on its own: the whole, without labels, and its ', ' parts."""
    parts = f"CASE WHEN contains({text}, ', ') THEN transform(split({text}, ', '), p -> trim(p)) ELSE cast(array() AS array<string>) END"
    return f"array_distinct(concat(array({text}), filter(concat(array(stripped), {parts}), p -> char_length(p) >= 2)))"


def fragment_best(df: DataFrame, key: str, text: str = "text", sensitivity: str = "balanced", typos: dict[str, str] | None = None) -> DataFrame:
    """The fragment of each message that covers it with the highest score.

    Only messages of 2 to 2,000 characters are judged. Messages no fragment covers have no row.
    """
    df = df.select(key, T.trim_all(F.col(text)).alias("whole")).filter(F.char_length("whole").between(2, 2000))
    df = df.withColumn("stripped", T.strip_ui_labels(F.col("whole")))
    parts = df.select(key, F.posexplode(F.expr(fragments("whole"))).alias("pos", "fragment"))
    judged = held_of(parts, "fragment", sensitivity, typos)
    best = judged.groupBy(key).agg(F.max(F.struct("score", F.col("pos").alias("p"), "fragment")).alias("b"))
    return best.select(key, F.col("b.score").alias("score"), F.col("b.fragment").alias("fragment"))


def rejoined_groups(df: DataFrame, covered: DataFrame, key: str, group: str, order: str, text: str = "text",
                    limit: int = 2000) -> DataFrame:
    """C7, the texts: groups of two or more parts, none of them covered, each as one text.

    A joined text over ``limit`` characters is not judged, so groups whose total length alone
    is over it are dropped by a sum before anything is collected: no group larger than the limit
    reaches a task.
    """
    parts = df.select(key, group, order, T.trim_all(F.col(text)).alias("part")).filter(
        F.char_length("part").between(2, 2000))
    marked = parts.join(covered.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    sizes = marked.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(F.char_length("part") + 1).alias("chars"), F.count("_hit").alias("hits"))
    wanted = sizes.filter((F.col("n") >= 2) & (F.col("chars") - 1 <= limit) & (F.col("hits") == 0)).select(group)
    return (parts.join(wanted, group, "left_semi").groupBy(group)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("part").alias("p")))).alias("ps"))
            .select(group, F.expr("array_join(ps.p, ' ')").alias("joined")))


def group_rejoin(df: DataFrame, covered: DataFrame, key: str, group: str, order: str, text: str = "text",
                 limit: int = 2000, sensitivity: str = "balanced", typos: dict[str, str] | None = None, every: bool = False) -> DataFrame:
    """Groups with no covered part, read as one text; those that are held. With ``every``, all of them, and whether each is ``held``."""
    whole = rejoined_groups(df, covered, key, group, order, text, limit)
    if every:
        judged = moderate(whole, "joined", keep=[group, "joined"], typos=typos)
        return judged.select(group, "joined", "score", F.expr(held(sensitivity)).alias("held"))
    return held_of(whole, "joined", sensitivity, typos).select(group, "joined", "score")


def offending_span(df: DataFrame, key: str, text: str = "text", sensitivity: str = "balanced", typos: dict[str, str] | None = None) -> DataFrame:
    """From the first to the last sentence that would be held; the whole text when there is
    one sentence only, or none holds."""
    whole = df.select(key, F.col(text).alias("whole"), T.sentences(F.col(text)).alias("parts"))
    sentences = whole.filter(F.size("parts") > 1).select(key, F.posexplode("parts").alias("pos", "sentence"))
    hot = (moderate(sentences, "sentence", typos=typos).filter(held(sensitivity))
           .groupBy(key).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")))
    span = F.expr("CASE WHEN lo IS NULL THEN trim(whole) ELSE trim(array_join(slice(parts, lo + 1, hi - lo + 1), '')) END")
    return whole.join(hot, key, "left").select(key, span.alias("span"), F.col("lo").isNotNull().alias("narrowed"))


def span_redact(text: str, span: str, replacement: str) -> Column:
    """The last occurrence of the span replaced; the text unchanged where it does not occur."""
    # The text ahead of the last occurrence is what is left once the span and all behind it go.
    tail = f"substring_index({text}, {span}, -1)"
    head = f"char_length({text}) - char_length({tail}) - char_length({span})"
    return F.expr(f"CASE WHEN {span} = '' OR NOT contains({text}, {span}) THEN {text}"
                  f" ELSE concat(left({text}, {head}), {replacement}, {tail}) END")


def looks_like_rewrite(original: str, rewrite: str) -> Column:
    """C10, the text test: a message of about the same length, not a refusal."""
    low = f"lower({rewrite})"
    refused = " OR ".join(f"contains({low}, {quote(r)})" for r in REFUSALS)
    return F.expr(f"{rewrite} != '' AND NOT startswith({low}, 'none') AND NOT ({refused}) AND char_length({rewrite})"
                  f" <= greatest(char_length({original}) * 3, char_length({original}) + 80)")


def rewrite_filter(pairs: DataFrame, original: str = "original", rewrite: str = "rewrite",
                   sensitivity: str = "balanced", typos: dict[str, str] | None = None) -> DataFrame:
    """Adds ``clean`` (quotes stripped), ``usable`` (looks like a rewrite) and ``accepted``
    (usable, and would not be held itself)."""
    given = pairs.columns
    trimmed = T.trim_all(F.col(rewrite))
    df = pairs.withColumn("_r", trimmed).withColumn("clean", F.expr(
        "CASE WHEN char_length(_r) > 1 AND startswith(_r, '\"') AND endswith(_r, '\"')"
        " THEN substring(_r, 2, char_length(_r) - 2) ELSE _r END")).drop("_r")
    df = df.withColumn("usable", looks_like_rewrite(original, "clean"))
    judged = moderate(df, "clean", keep=[*given, "clean", "usable"], typos=typos)
    return judged.withColumn("accepted", F.expr(f"usable AND NOT {held(sensitivity)}")).select(
        *given, "clean", "usable", "score", "accepted")


