"""Centroid clustering over a kept matrix of dot products.

Components are integers, so every figure is exact. A vector's dot products with all centroids are stored beside it. When centroids
move, only the components that changed are multiplied and added; the nearest centroid follows from |x|^2 - 2 x.c + |c|^2.
Vectors lie in blocks of ``BLOCK_ROWS``, and each round's blocks are written to the shared folder, so no round repeats another's work.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import shared_folder

#: Vectors of a block: one row of the stored table, and what a task holds at a time.
BLOCK_ROWS = 4096
#: Components beyond it would let squared distances leave 64 bits.
LARGEST = 2**26
BLOCK = "ids array<long>, kind string, points binary, norms binary, dot_kind string, dots binary, sums binary, counts binary"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def valid(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id, embedding (doubles) of the vectors that take part: those of ``dims`` components, all finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.size("embedding") == dims).where(fine)


def whole(components: np.ndarray, scale: int) -> np.ndarray:
    """The components as integers, floor(scale * x)."""
    made = np.floor(components * scale)
    if len(made) and np.abs(made).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} / {scale}: squared distances would not fit 64 bits")
    return made.astype(np.int64)


def small(a: np.ndarray) -> tuple[str, bytes]:
    """Integers in the narrowest type that holds them."""
    top = int(np.abs(a).max()) if a.size else 0
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
    return kind, a.astype(kind).tobytes()


def added(dots: np.ndarray, points: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """The dot products after centroids moved by ``moved`` (centroids, components): only components that changed are read."""
    most = int(np.abs(points).max(initial=0)) * int(np.abs(moved).sum(axis=1).max(initial=0))
    read = points.astype(np.float64) if most < 2**53 else points  # whole numbers below 2^53 are exact in doubles
    for c, change in enumerate(moved):
        at = np.flatnonzero(change)
        if len(at):
            dots[:, c] += (read[:, at] @ change[at].astype(read.dtype)).astype(np.int64)
    return dots


def nearest(norms: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; of equally near centroids the smaller number."""
    far = norms[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None, :]
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(far)), cluster]


def block_row(ids: pa.Array, points: np.ndarray, norms: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> pa.RecordBatch:
    cluster, _ = nearest(norms, dots, centroids)
    member = (cluster[None, :] == np.arange(len(centroids))[:, None]).astype(np.float64)
    sums = (member @ points.astype(np.float64)).astype(np.int64)  # at most 2^12 * 2^26: exact
    kind, raw = small(points)
    dot_kind, raw_dots = small(dots)
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    rest = [[kind], [raw], [norms.astype("<i8").tobytes()], [dot_kind], [raw_dots], [sums.astype("<i8").tobytes()], [member.sum(axis=1).astype("<i8").tobytes()]]
    return pa.RecordBatch.from_arrays([listed, *map(pa.array, rest)], names=["ids", "kind", "points", "norms", "dot_kind", "dots", "sums", "counts"])


def opened(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of a batch: ids, points, norms, dots."""
    for k in range(len(batch)):
        ids, kind, raw, norms, dot_kind, dots = (batch.column(n)[k] for n in ("ids", "kind", "points", "norms", "dot_kind", "dots"))
        n = len(ids.values)
        yield (ids.values, np.frombuffer(raw.as_py(), kind.as_py()).astype(np.int64).reshape(n, -1), np.frombuffer(norms.as_py(), "<i8"),
               np.frombuffer(dots.as_py(), dot_kind.as_py()).astype(np.int64).reshape(n, -1))


def first_blocks(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """Blocks of vectors with their dot products: the centroids have moved there from nought."""
    def made(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        points = whole(np.concatenate(parts), scale)
        dots = added(np.zeros((len(points), len(centroids)), np.int64), points, centroids)
        return block_row(pa.concat_arrays(ids), points, (points * points).sum(axis=1), dots, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for at in range(0, len(batch), BLOCK_ROWS):
                part = matrix[at:at + BLOCK_ROWS]
                if held + len(part) > BLOCK_ROWS:
                    yield made(ids, parts)
                    ids, parts, held = [], [], 0
                ids.append(batch.column(0).slice(at, len(part)))
                parts.append(part)
                held += len(part)
        if held:
            yield made(ids, parts)

    return rows.mapInArrow(run, BLOCK)


def next_blocks(blocks: DataFrame, moved: np.ndarray, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, norms, dots in opened(batch):
                yield block_row(ids, points, norms, added(dots, points, moved), centroids)

    return blocks.mapInArrow(run, BLOCK)


def assigned(blocks: DataFrame, moved: np.ndarray, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, norms, dots in opened(batch):
                cluster, far = nearest(norms, added(dots, points, moved), centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def kept(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def moved_to(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids' next places: floors of exact means. Each task adds up its blocks; at most centroids * (components + 1) rows reach the driver."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for sums, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[:, :dims] += np.frombuffer(sums, "<i8").reshape(k, dims)
                total[:, dims] += np.frombuffer(counts, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * (dims + 1)), pa.int64()), pa.array(total.ravel(), pa.int64())], names=["place", "total"])

    sums = blocks.select("sums", "counts").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    exact = {r.place: int(r.total) for r in sums.collect()}
    made = centroids.copy()
    for c in range(k):
        count = exact.get(c * (dims + 1) + dims, 0)
        if count:
            made[c] = [exact[c * (dims + 1) + j] // count for j in range(dims)]
    return made


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    Vectors that are null, of other than ``dims`` components, or hold null or non-finite ones take no part. Centroids start as the k vectors
    whose sha256 of ``seed`` and vec_id is smallest (fewer, if there are fewer vectors); rows of one vec_id by their components. Repeated rows
    are vectors of their own; one without vec_id is clustered and returned with null, but is no first centroid. Ties go to the smaller number.
    Other columns are ignored; an empty table, or one without any vec_id, gives an empty result. Components beyond 2^26 after scaling end the job with a message.
    """
    spark, rows = vectors.sparkSession, valid(vectors, dims)
    drawn = rows.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256), "embedding").limit(k).collect()
    if not drawn:
        return spark.createDataFrame([], RESULT)
    centroids = whole(np.array([r.embedding for r in drawn], np.float64), scale)
    blocks = kept(first_blocks(rows, centroids, scale))
    for last in range(rounds - 1, -1, -1):
        place = moved_to(blocks, centroids)
        moved, centroids = place - centroids, place
        if not moved.any() or not last:  # nothing will move any more, or the last round is over
            break
        blocks = kept(next_blocks(blocks, moved, centroids))
    else:
        moved = np.zeros_like(centroids)
    found = kept(assigned(blocks, moved, centroids))
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of_cluster = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row a centroid: k rows at most.
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
