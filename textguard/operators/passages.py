"""The passage of a long document that scores highest.

Every window of every text is scored where the text lies; what is shuffled is one (key, score, start) per text and task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators.cascade import moderate
from textguard.operators.normalize import passage_window


def judged(windows: DataFrame) -> DataFrame:
    """The default score of a window: the cascade's local verdict."""
    return moderate(windows, "passage_text", keep=["_key", "start"])


def best_passage(df: DataFrame, key: str, text: str = "text", size: int = 1500, step: int = 640,
                 score_fn: Callable[[DataFrame], DataFrame] = judged) -> DataFrame:
    """One row per key: ``start`` (characters before the window), ``score`` and ``passages`` (how many windows were read).

    ``score_fn`` gets ``_key``, ``start`` and ``passage_text`` and adds ``score``. Of windows that score alike the first wins. A null text
    is an empty one, which is one window. Rows that share a key, a null key among them, are parts of one document: the best window of any of
    them is returned. Other columns of ``df`` are not looked at.
    """
    if not 0 < step <= size:
        raise ValueError("step must be positive and no longer than size, or text between windows would be skipped")
    texts = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    windows = passage_window(texts, "_text", size, step).select("_key", "start", "passage_text")
    # The greatest (score, -start) needs one row a key in memory, before the shuffle and after it.
    best = score_fn(windows).groupBy("_key").agg(
        F.max(F.struct("score", (-F.col("start")).alias("back"))).alias("_best"), F.count("*").alias("passages"))
    return best.select(F.col("_key").alias(key), (-F.col("_best.back")).alias("start"), F.col("_best.score").alias("score"), "passages")


def passage_at(text: str, start: str = "start", size: int = 1500) -> Column:
    """The window of a text that begins at ``start``, as :func:`best_passage` read it."""
    raw = f"substring({text}, {start} + 1, {size})"
    return F.expr(rf"CASE WHEN {start} > 0 AND NOT substring({text}, {start}, 1) RLIKE r'\s' THEN regexp_replace({raw}, r'^\S+', '') ELSE {raw} END")
