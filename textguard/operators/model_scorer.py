"""A trained model as the cascade's scorer, in batches, with a second look at disguised texts.

The model reads a text as it was written, since case and punctuation are part of what it has learned. Disguised spelling reads as noise to it,
so a text with signs or digits that may stand for letters is also read in its plain form, and the higher score counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textguard.functions import text as T
from textguard.functions.arrays import quote

# Characters that may stand for letters.
DISGUISES = "*#%@$0134578"


@dataclass(frozen=True)
class BatchScorer:
    """Adds ``model_score`` (0..1) and ``looks`` (how many texts of the row the model has read: 0, 1 or 2).

    ``load`` runs once for each Python worker and returns a function from an array of texts to an array of probabilities; it gets at most
    2 x ``batch_size`` texts a call, and never an empty one. Rows outside ``where``, and texts that are null or blank, are not read and score 0, as does
    a text whose probability is not a number. Probabilities beyond 0 and 1 are cut back to them.

    The frame needs the text as written and ``plain`` of :func:`textguard.operators.normalize.normalize`.
    """

    load: Callable[[], Callable[[np.ndarray], np.ndarray]]
    text: str = "text"
    batch_size: int = 64

    def __call__(self, df: DataFrame, where: str = "true") -> DataFrame:
        missing = {self.text, "plain"} - set(df.columns)
        if missing:
            raise ValueError(f"the scorer needs the columns {', '.join(sorted(missing))}")
        given = df.columns
        df = df.withColumn("_first", F.when(F.expr(where), T.trim_all(F.col(self.text))))
        disguised = f"_first RLIKE {quote('[' + DISGUISES + ']')} AND plain != lower(_first)"
        df = df.withColumns({"_first": F.coalesce("_first", F.lit("")), "_second": F.expr(f"CASE WHEN {disguised} THEN plain ELSE '' END")})
        score = predict_batch_udf(higher(self.load), return_type=DoubleType(), batch_size=self.batch_size)
        # A row that is not read goes through as two empty texts: the frame is not split, so what made it runs once.
        return df.select(*[c for c in given if c not in ("model_score", "looks")], score("_first", F.coalesce("_second", F.lit(""))).alias("model_score"),
                         F.expr("cast(_first != '' AS int) + cast(coalesce(_second, '') != '' AS int)").alias("looks"))


def higher(load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """The model over pairs (as written, plain or empty): the higher of the two probabilities."""
    def make():
        model = load()

        def predict(first: np.ndarray, second: np.ndarray) -> np.ndarray:
            texts = np.concatenate([first, second])
            read = np.flatnonzero(texts != "")
            scores = np.zeros(len(texts))
            if len(read):
                scores[read] = np.clip(np.nan_to_num(np.asarray(model(texts[read]), float).reshape(-1), nan=0.0), 0.0, 1.0)
            return scores.reshape(2, -1).max(axis=0)

        return predict

    return make
