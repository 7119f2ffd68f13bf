"""Training corpora (M1-M8, U4, U5, N17, A7): cleaning, labelling, expansion, splits, training."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.functions.arrays import words
from textguard.operators.normalize import resolve_masks
from textguard.session import checkpoint_dir

# Endings put behind templates and behind plain chat lines.
TEMPLATE_TAILS = ["", "lol", "honestly", "fr", "tbh", "…", "!", ".", "i guess", "anyway",
                  "just saying", "seriously", "ok", "\U0001F642", "whatever"]
CHAT_TAILS = ["", "lol", "lmao", "fr", "tbh", "honestly", "!", "bro", "dude", "ngl"]

# At most so many rows of the two harmless classes.
CLASS_CAPS = {"neg": 14_000, "swear": 1_500}


def clean_corpus(df: DataFrame, text: str = "text", out: str = "clean") -> DataFrame:
    """Mark-up stripped, then normalised exactly as messages are at scoring time."""
    df = df.withColumn(out, T.fold_characters(T.strip_markup(F.col(text))))
    df = df.withColumn(out, resolve_masks(out))
    return df.withColumn(out, T.collapse_space(T.fold_leet(F.col(out))))


def label_3class(df: DataFrame, label: str = "class") -> DataFrame:
    """M1: class 0 is harmful, 2 is ok, the class in between is left out."""
    return df.withColumn("label", F.expr(f"CASE CAST({label} AS STRING) WHEN '0' THEN 'harmful' WHEN '2' THEN 'ok' END")).filter(
        "label IS NOT NULL")


def label_multi(df: DataFrame) -> DataFrame:
    """M2: aimed harm is positive; neither toxic nor obscene is negative; mere swearing is its own."""
    return df.withColumn("cls", F.expr("""CASE
        WHEN insult = 1 OR threat = 1 OR identity_hate = 1 OR severe_toxic = 1 THEN 'pos'
        WHEN toxic = 0 AND obscene = 0 THEN 'neg'
        WHEN obscene = 1 AND insult = 0 THEN 'swear' END""")).filter("cls IS NOT NULL")


def draw(key: str, seed: int) -> Column:
    """A repeatable random number in [0, 1) from a row's key; the same in any engine with MD5."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def class_cap(df: DataFrame, caps: dict[str, int] | None = None, seed: int = 11, key: str = "doc_id") -> DataFrame:
    """M3: a repeatable random choice of at most so many rows per capped class.

    The cap is the feature. Rows are ranked in slices of the random number, then only each
    slice's leaders are ranked again, so a class of any size is never sorted in one task.
    """
    caps = CLASS_CAPS if caps is None else caps
    df = df.withColumn("_draw", draw(key, seed))
    table = "map(" + ", ".join(f"'{c}', {n}" for c, n in caps.items()) + ")"
    df = df.withColumn("_cap", F.expr(f"try_element_at({table}, cls)")).withColumn("_slice", F.floor(F.col("_draw") * 4096))
    order = [F.col("_draw"), F.col(key)]
    capped = df.filter("_cap IS NOT NULL")
    sizes = capped.groupBy("cls", "_slice").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("cls").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("cls", "_slice").orderBy(*order))
    chosen = (capped.join(F.broadcast(sizes), ["cls", "_slice"]).filter("_before < _cap")  # 4,096 rows per class at most
              .withColumn("_place", place + F.col("_before")).filter("_place <= _cap").drop("_before", "_place"))
    return chosen.unionByName(df.filter("_cap IS NULL")).drop("_draw", "_cap", "_slice")


def template_expand(df: DataFrame, text: str = "text", tails: list[str] | None = None) -> DataFrame:
    """M4: every line with every tail; white space squeezed. A narrow explode, no join."""
    tails = TEMPLATE_TAILS if tails is None else tails
    return (df.withColumn("tail", F.explode(F.expr(words(tails))))
            .withColumn("expanded", F.trim(F.regexp_replace(F.concat_ws(" ", text, "tail"), r"\s+", " "))))


def slot_fill(df: DataFrame, frames: list[str], slots: dict[str, list[str]], key: str, seed: int = 11) -> DataFrame:
    """M5: one line per row from a grammar: a frame chosen by the row's key, each slot filled by
    another draw. "a" before a vowel becomes "an"; repeated lines are dropped."""
    def pick(values: list[str], salt: str) -> str:
        return (f"get({words(values)}, cast(pmod(xxhash64(cast({key} AS string), '{salt}:{seed}'),"
                f" {len(dict.fromkeys(values))}) AS int))")

    df = df.withColumn("line", F.expr(pick(frames, "frame")))
    for slot, values in slots.items():
        df = df.withColumn("line", F.expr(f"replace(line, '{{{slot}}}', {pick(values, slot)})"))
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    line = F.regexp_replace(line, r"\ba ([aeiou])", "an $1")
    return exact_dedupe(df.select(line.alias("line")), "line")


def oversample(df: DataFrame, times: int = 4) -> DataFrame:
    """M6: each row so many times."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def corpus_union(*parts: tuple[str, DataFrame, int]) -> DataFrame:
    """U4: (origin, rows of text and label, repeats) put together."""
    out = None
    for origin, df, times in parts:
        rows = oversample(df.select("text", "label"), times).drop("copy").withColumn("origin", F.lit(origin))
        out = rows if out is None else out.unionByName(rows)
    return out


def exact_dedupe(df: DataFrame, *keys: str) -> DataFrame:
    """One row per distinct key. Copies are dropped on the map side before the shuffle."""
    return df.dropDuplicates(list(keys))


def split(df: DataFrame, key: str, train: float = 0.85, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """M7: a stable split by a hash of the key; a row keeps its side when the corpus grows."""
    marked = df.withColumn("_draw", draw(key, seed))
    return marked.filter(F.col("_draw") < train).drop("_draw"), marked.filter(F.col("_draw") >= train).drop("_draw")


def label_counts(df: DataFrame) -> DataFrame:
    """Rows per origin and label."""
    return df.groupBy("origin", "label").agg(F.count("*").alias("n"))


def train_bow(df: DataFrame, tokens: str = "tokens", label: str = "label", features: int = 1 << 16, path: str | None = None) -> PipelineModel:
    """M8: a bag-of-words classifier on normalised tokens; ok is class 0, harmful class 1.

    The model is written to the folder ``path`` (a new one below the checkpoint folder, if none is given) and read from there. As it comes from the fit
    it holds on to a training summary and with that to the session, which cannot be sent to tasks once anything in it was observed.
    ``df`` is read several times: normalise it beforehand.
    """
    stages = [
        StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetDesc", handleInvalid="skip"),
        HashingTF(inputCol=tokens, outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label_id", maxIter=20, regParam=0.01),
    ]
    path = path or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/textguard/{uuid.uuid4().hex}/bow"
    Pipeline(stages=stages).fit(df).write().overwrite().save(path)
    return PipelineModel.load(path)


def model_scorer(model: PipelineModel, positive: int = 1):
    """A trained pipeline as a scorer: adds ``model_score`` from the columns it was trained on."""
    from pyspark.ml.functions import vector_to_array

    scoring = PipelineModel(model.stages[1:])  # no label at scoring time

    def score(df: DataFrame) -> DataFrame:
        extra = ["tf", "features", "rawPrediction", "probability", "prediction"]
        return scoring.transform(df).withColumn("model_score", vector_to_array("probability")[positive]).drop(*extra)

    return score


def probe_table(df: DataFrame, probe: str, scorer) -> DataFrame:
    """A scorer's opinion on probe lines, wherever the (normalised) messages carry them: how often, and the highest score."""
    return scorer(df).groupBy(probe).agg(F.count("*").alias("n"), F.max("model_score").alias("max_score"))
