"""Evaluation and regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators.cascade import lexical_scorer, local_verdict
from textguard.operators.normalize import LEXICAL, normalize
from textguard.operators.phrase_index import stored
from textguard.operators.policy import expectation_met, hold_policy
from textguard.operators.tier0 import level_of, tier0_verdict


def evaluate_classifier(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """M9: confusion counts as one row, with accuracy."""
    def n(a: int, p: int):
        return F.count_if((F.col(actual) == a) & (F.col(predicted) == p))

    counts = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    return counts.withColumn("accuracy", F.expr("round((tp + tn) / cast(tp + fp + fn + tn AS double), 4)"))


def document_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The lexical score and level of every document."""
    scored = lexical_scorer(normalize(docs.select(key, text), text, keep=LEXICAL))
    return scored.select(key, "model_score", F.expr(level_of("model_score")).alias("level"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids and texts of the documents that have a label; the others need no score to be held against one."""
    return docs.select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi")


def doc_toxicity_eval(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The lexical verdict on documents against their labels: counts per (level, toxic).

    Only documents with a label are scored. Where the labelled ids are too many to be broadcast, the semi-join shuffles id and
    text once; after that only ids and scores move.
    """
    gold = labels.select("doc_id", "toxic")
    return (document_scores(labelled(docs, gold)).join(gold, "doc_id").groupBy("level", "toxic")
            .agg(F.count("*").alias("docs"), F.round(F.avg("model_score"), 6).alias("avg_score")))


# Characters that are a token each, first and last of each block of ideographs.
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
PUNCTUATION = r"\p{P}$+<=>^`|~"


def token_lengths(df: DataFrame, key: str, text: str = "text", budget: int = 64) -> DataFrame:
    """Basic tokens per text against a token budget: words, and punctuation and ideographs each on their own.

    Control and format characters, other than tab and line ends, and replacement characters are dropped before; only spaces, tabs and line ends part words.
    """
    shown = F.regexp_replace(F.col(text), r"[\p{C}\x{FFFD}&&[^\t\n\r]]", "")
    pieces = F.regexp_extract_all(T.fold_unicode(shown), F.lit(rf"[{PUNCTUATION}{IDEOGRAPHS}]|[^ \t\n\r\p{{Zs}}{PUNCTUATION}{IDEOGRAPHS}]+"), F.lit(0))
    return df.select(key, F.size(pieces).alias("n_tokens")).withColumn("over_budget", F.col("n_tokens") > budget)


def verdict_parity(expected: DataFrame, got: DataFrame, key: str, score: str = "score", tolerance: float = 0.02) -> DataFrame:
    """How far two scorers are apart, as one row."""
    both = expected.select(key, F.col(score).alias("a")).join(got.select(key, F.col(score).alias("b")), key, "full_outer")
    gap = F.abs(F.col("a") - F.col("b"))
    return both.agg(
        F.count("*").alias("n"), F.round(F.max(gap), 6).alias("max_diff"),
        F.count_if(gap > tolerance).alias("over_tolerance"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
    ).withColumn("passed", F.expr(f"coalesce(max_diff <= {tolerance}, true) AND unmatched = 0"))


def regression_suite(golden: DataFrame, scorer=lexical_scorer) -> DataFrame:
    """Per suite, how many expectations hold. ``golden``: case_id, suite, sensitivity, text, expect."""
    verdicts = local_verdict(tier0_verdict(golden, "text"), scorer)
    judged = hold_policy(verdicts.withColumnRenamed("sensitivity", "wanted")).filter("sensitivity = wanted")
    return judged.withColumn("met", expectation_met()).groupBy("suite").agg(
        F.count("*").alias("cases"), F.count_if("met").alias("met"))


def attach_context(df: DataFrame, key: str, context: str = "context") -> DataFrame:
    """Context given as an array of raw lines: normalised, and reduced to what the rules read.

    A line's words come from the same normaliser; the few lines of a case are regrouped by key.
    """
    lines = df.select(key, F.posexplode(context).alias("pos", "line"))
    tokens = normalize(lines, "line", keep=["tokens"]).select(key, "pos", F.expr("array_distinct(filter(tokens, w -> char_length(w) > 2))").alias("w"))
    grouped = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws"))
    joined = df.join(grouped, key, "left")
    return joined.withColumns({
        "context_size": F.expr(f"least(coalesce(size({context}), 0), 12)"),
        "context_words": F.expr("coalesce(slice(ws, greatest(size(ws) - 5, 1), 6).w, cast(array() AS array<array<string>>))"),
    }).drop("ws")


def fixture_replay(fixtures: DataFrame, sensitivity: str = "balanced", scorer=lexical_scorer, path: str | None = None) -> DataFrame:
    """Fixtures with their context through the local tiers: one row per case, ``met``.

    With ``path``, the fixtures and then what the rules read of their context are written below that folder and read from there. Whatever makes the
    fixtures then runs once, and no shuffle is planned together with the tiers: each adaptive step describes the plan anew to the
    driver's listeners, and the tiers' word lists and patterns are by far the longest part of it.
    """
    ready = attach_context(stored(fixtures, f"{path}/cases") if path else fixtures, "id").drop("context")
    ready = stored(ready, f"{path}/ready") if path else ready
    verdicts = local_verdict(tier0_verdict(ready, "draft", keep=["id", "expect", "draft"]), scorer)
    judged = hold_policy(verdicts).filter(F.col("sensitivity") == sensitivity)
    return judged.withColumn("met", expectation_met()).select("id", "expect", "held", "distress", "score", "met")


def summary_line(spark: SparkSession, replay: DataFrame) -> DataFrame:
    """"n/m correct"."""
    return replay.agg(F.concat_ws("/", F.count_if("met").cast("string"), F.count("*").cast("string")).alias("correct"))
