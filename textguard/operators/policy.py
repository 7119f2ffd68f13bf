"""From a verdict to a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions.arrays import mapping, quote, words
from textguard.operators.tier0 import level_of

# Sensitivity, score from which a message is held, lowest level that can be held.
SENSITIVITIES = [("light", 0.80, 2), ("balanced", 0.62, 1), ("attentive", 0.45, 1)]

# Categories, most serious first.
CATEGORY_ORDER = ["threat", "harassment", "slur", "explicit", "insult", "exclusion", "pileOn", "backhanded",
                  "sarcasm", "codedLanguage", "profanity"]

# The sentence shown for a category.
REASONS = {
    "exclusion": "Shuts someone out",
    "backhanded": "A compliment with an insult inside it",
    "sarcasm": "Reads as mockery",
    "pileOn": "Repeats what others already said at one person",
    "threat": "Reads as a threat",
    "slur": "Contains a slur",
    "harassment": "Aimed at hurting someone",
    "explicit": "Explicit language",
    "profanity": "Swearing",
}
DEFAULT_REASON = "Aimed at a person"


def level_bucket(score: str) -> Column:
    """F1."""
    return F.expr(level_of(score))


def severity_label(score: str) -> Column:
    """F2: Sharp below 0.55, Harsh below 0.78, Cruel from there; the score is clamped first."""
    s = f"least(greatest({score}, 0e0), 1e0)"
    return F.expr(f"CASE WHEN {s} < 0.55e0 THEN 'Sharp' WHEN {s} < 0.78e0 THEN 'Harsh' ELSE 'Cruel' END")


#: Every message is paired with every row of a policy, so a policy is small.
MAX_PROFILES = 1000
PROFILES = "array<struct<sensitivity:string,threshold:double,minimum_level:int>>"


def level_rank(level: str) -> str:
    return f"array_position(array('clear', 'borderline', 'harmful'), {level}) - 1"


def policy_table(spark: SparkSession) -> DataFrame:
    """The default thresholds; any table of this shape can stand in."""
    return spark.createDataFrame(SENSITIVITIES, "sensitivity string, threshold double, minimum_level int")


def held(sensitivity: str, score: str = "score", level: str = "level", own: str = "self_directed") -> str:
    """F3 for one fixed sensitivity, as an expression."""
    _, threshold, minimum = next(s for s in SENSITIVITIES if s[0] == sensitivity)
    return f"(NOT {own} AND {level_rank(level)} >= {minimum} AND {score} >= {threshold}e0)"


def hold_policy(df: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """one row per (message, sensitivity) with ``held``.

    The policy has a handful of rows; each message is paired with all of them by exploding a literal, so nothing is joined at all. A policy
    of one's own (sensitivity, threshold, minimum_level) may have up to ``MAX_PROFILES`` rows, and more end the job with a message; a row with a null threshold or
    level holds nothing, an empty policy gives no rows, and columns of these names in ``df`` give way to the policy's.
    """
    rule = f"NOT self_directed AND {level_rank('level')} >= minimum_level AND score >= threshold"
    if policy is None:
        rows = ", ".join(f"struct('{n}' AS sensitivity, {t}e0 AS threshold, {m} AS minimum_level)" for n, t, m in SENSITIVITIES)
        profiles = F.expr(f"array({rows})")
    else:
        given = policy.select("sensitivity", F.col("threshold").cast("double"), F.col("minimum_level").cast("int")).limit(MAX_PROFILES + 1).collect()
        if len(given) > MAX_PROFILES:
            raise ValueError(f"a policy has at most {MAX_PROFILES} rows")
        profiles = F.array(*[F.struct(F.lit(n), F.lit(t), F.lit(m)) for n, t, m in given]).cast(PROFILES)
        rule = f"coalesce({rule}, false)"
        df = df.drop("sensitivity", "threshold", "minimum_level")
    paired = df.withColumn("policy", F.explode(profiles)).select("*", "policy.*").drop("policy")
    return paired.withColumn("held", F.expr(rule)).drop("threshold", "minimum_level")


def cover_policy(df: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """incoming messages; a model all but certain covers too, except at the light setting."""
    return hold_policy(df, policy).withColumn("covered", F.expr(
        "NOT self_directed AND (held OR (pending AND model_score >= 0.98e0 AND sensitivity != 'light'))"))


def offer_policy(df: DataFrame, incoming: bool = False) -> DataFrame:
    """messages beside which help is offered."""
    return df.filter("distress AND self_directed" if incoming else "distress")


def primary_category(categories: str = "categories") -> Column:
    """the most serious category there is."""
    return F.expr(f"get(filter({words(CATEGORY_ORDER)}, c -> array_contains({categories}, c)), 0)")


def reason_text(df: DataFrame) -> DataFrame:
    """the reviewer's rationale, else a sentence for the primary category."""
    df = df.withColumn("primary_category", primary_category())
    return df.withColumn("reason", F.expr(
        f"coalesce(nullif(rationale, ''), try_element_at({mapping(REASONS)}, primary_category),"
        f" if(primary_category IS NULL, null, {quote(DEFAULT_REASON)}))"))


def expectation_met(expect: str = "expect", held_col: str = "held", distress: str = "distress") -> Column:
    """hold, pass or offer against what happened."""
    return F.expr(f"CASE {expect} WHEN 'hold' THEN {held_col} WHEN 'pass' THEN NOT {held_col}"
                  f" WHEN 'offer' THEN NOT {held_col} AND {distress} ELSE false END")


def age_label(seconds: str, clock: str) -> Column:
    """How long ago, the way a live log says it."""
    return F.expr(f"CASE WHEN {seconds} < 2 THEN 'now' WHEN {seconds} < 60 THEN concat(cast({seconds} AS string), 's')"
                  f" WHEN {seconds} < 3600 THEN concat(cast({seconds} div 60 AS string), 'm') ELSE {clock} END")


def speed_label(ms: str) -> Column:
    """A latency as text: under a millisecond, in milliseconds, or in seconds."""
    return F.expr(f"CASE WHEN {ms} < 1 THEN '<1 ms' WHEN {ms} < 1000 THEN concat(cast(cast(bround({ms}, 0) AS bigint) AS string), ' ms')"
                  f" ELSE concat(format_string('%.1f', bround({ms} / 1000, 1)), ' s') END")
