"""Approximate nearest neighbours by a permutation index.

A vector stands for the order in which it sees ``PIVOTS`` pivots. The rows lie in blocks; a block has an inverted file for each pivot:
the rows that have it among their ``POSTED`` nearest. A query takes the rows of its own nearest pivots' files, ranks them by footrule
distance (the sum over all pivots of the difference in position) and computes the cosine of the best ranked on the original vectors.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, POSTED = 128, 12
#: Rows of a block, which is what one task holds at a time.
BLOCK_ROWS = 8192
#: Of a block's rows the best ranked that are compared exactly: this share, and at least so many.
RERANKED, LEAST_RERANKED = 0.05, 64
QUERY_BATCH = 256


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding array<double> of the rows that take part, one for each vec_id (the smallest vector of repeated ones)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where("vec_id is not null and embedding is not null").where(fine)
    usual = rows.agg(F.mode(F.size("embedding"))).first()[0]
    return rows.where(F.size("embedding") == F.lit(usual or 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def fit_pivots(rows: DataFrame, pivots: int = PIVOTS, seed: int = 1) -> np.ndarray:
    """Different unit vectors out of a sample of 8 * pivots rows, drawn by the hash of their ids: all that reaches the driver."""
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(8 * pivots).collect()
    found = np.array(list(dict.fromkeys(tuple(r["embedding"]) for r in drawn))[:pivots])
    return found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found


def positions(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of each pivot in each vector's order, nearest first; equally near ones in the pivots' order."""
    order = np.argsort(-(units @ pivots.T), axis=1, kind="stable")
    place = np.empty(order.shape, np.int16)
    np.put_along_axis(place, order, np.arange(len(pivots), dtype=np.int16)[None, :], 1)
    return place


class Block:
    """Rows in ascending vec_id, their orders, and the inverted file of each pivot."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, posted: int):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.pivots, self.posted = ids[by], vectors[by], pivots, min(posted, len(pivots))
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.place = positions(self.vectors / self.norms[:, None], pivots)
        near = self.place < self.posted
        self.files = [np.flatnonzero(near[:, p]) for p in range(len(pivots))]

    def nearest(self, query: int, vector: np.ndarray, place: np.ndarray, k: int, reranked: float, least: int) -> list[tuple[int, float]]:
        rows = np.arange(len(self.ids))
        met = np.zeros(len(self.ids), bool)
        for p in np.flatnonzero(place < self.posted):
            met[self.files[p]] = True
        met &= self.ids != query
        found = rows[met]
        wanted = max(least, int(reranked * len(self.ids)))
        far = np.abs(self.place[found] - place).sum(axis=1, dtype=np.int64)
        if len(found) > wanted:  # equally far rows by vec_id
            found = found[np.argpartition(far * len(rows) + found, wanted)[:wanted]]
        elif len(found) < least:  # too few in the files: the others by footrule distance
            rest = rows[~met & (self.ids != query)]
            key = np.abs(self.place[rest] - place).sum(axis=1, dtype=np.int64) * len(rows) + rest
            found = np.r_[found, rest[np.argsort(key)[:least - len(found)]]]
        score = (self.vectors[found] * vector).sum(axis=1) / (self.norms[found] * np.sqrt((vector * vector).sum()))
        best = np.lexsort((self.ids[found], -score))[:k]
        return list(zip(self.ids[found][best].tolist(), score[best].tolist(), strict=True))


def search(vectors: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, posted: int = POSTED, reranked: float = RERANKED, least: int = LEAST_RERANKED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest cosine found for each row that ``is_query`` (a condition) names.

    Ties go to the smaller vec_id; a query's own vec_id is no candidate; with fewer candidates all come. Vectors that are null, zero, hold
    null or non-finite components, or differ in length from most, take no part; repeated vec_ids count once; other columns are ignored;
    an empty table gives an empty result. Data blocks of ``BLOCK_ROWS`` are held one at a time, the queries stream past them.
    """
    rows = valid(vectors)
    centre = fit_pivots(rows, pivots)
    blocks = rows.count() // BLOCK_ROWS + 1
    data = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "embedding")
    asked = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "embedding")
    placed = data.union(asked).repartition("block").sortWithinPartitions("block", "kind", "vec_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, parts, block = -1, [], [], None
        for batch in batches:
            # Rows come sorted: a block's data, then its queries.
            cuts = np.flatnonzero(np.diff(batch["block"].to_numpy() * 2 + batch["kind"].to_numpy())) + 1
            for part in np.split(np.arange(len(batch)), cuts):
                if not len(part):
                    continue
                some = batch.iloc[part]
                number, kind = int(some["block"].iloc[0]), int(some["kind"].iloc[0])
                if number != at:
                    at, ids, parts, block = number, [], [], None
                matrix = np.array(some["embedding"].tolist(), np.float64)
                if kind == 0:
                    ids.append(some["vec_id"].to_numpy())
                    parts.append(matrix)
                    continue
                if not ids:
                    continue
                if block is None:
                    block = Block(np.concatenate(ids), np.concatenate(parts), centre, posted)
                places = positions(matrix / np.linalg.norm(matrix, axis=1, keepdims=True), centre)
                out = [(q, v, s) for q, vector, place in zip(some["vec_id"].tolist(), matrix, places, strict=True) for v, s in block.nearest(q, vector, place, k, reranked, least)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = placed.mapInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
