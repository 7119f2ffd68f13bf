"""Best-fit packing of documents into sequences, after a Martello-Toth dominance reduction.

Packing looks at lengths only, and there are at most ``capacity`` of them. So the instance is a histogram (at most ``capacity``
numbers, whatever the corpus holds): the driver reduces and packs that histogram into patterns, each with the number of sequences
it is used for, and Spark deals the pieces of each length out to the places that the patterns have for it.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import byte_ids, stored, texts_of

#: Rows of one length that are numbered by one task.
ROWS_TO_NUMBER = 50_000
Pattern = tuple[tuple[int, int], ...]  # (length, how many of it)


def cut(docs: DataFrame, path: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every tokenised text, ``end_id`` appended. Map-only.

    A null or empty text is one piece of the end id alone. Only a document of more than ``capacity`` ids is cut: the first piece takes
    what is over, so that all others are full. Repeated rows give repeated pieces; rows without doc_id are dropped.
    """
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), byte_ids(batch.column(1).to_pylist(), path), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                borders = [0, *range(first, n + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a:4 * b])) for k, (a, b) in enumerate(zip(borders, borders[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Sizes:
    """A multiset of lengths that knows its distinct lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            del self.order[bisect_left(self.order, size)]

    def largest(self, most: int) -> int:
        """The largest length of at most ``most``, or 0."""
        k = bisect_right(self.order, most)
        return self.order[k - 1] if k else 0

    def smallest(self, k: int) -> list[int]:
        found: list[int] = []
        for s in self.order:
            found += [s] * min(self.counts[s], k - len(found))
            if len(found) == k:
                break
        return found

    def best_pair(self, most: int) -> int:
        """The largest sum of two of the lengths that is at most ``most``, or 0."""
        best, low, high = 0, 0, len(self.order) - 1
        while low <= high:
            a, b = self.order[low], self.order[high]
            if a + b > most or low == high and self.counts[a] < 2:
                high -= 1
            else:
                best, low = max(best, a + b), low + 1
        return best


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sequences that some best packing contains, and the lengths left over.

    For a longest piece w with r places left beside it, a set beside w is fixed if every other set that fits there could be swapped
    for it without needing more sequences:
    nothing fits; a piece of exactly r; the longest fitting piece where no two fit; the longest fitting piece where no three fit and
    no two that fit are longer together.
    """
    left, fixed = Sizes(counts), []
    changed = True
    while changed:
        changed = False
        for w in sorted(left.counts, reverse=True):
            while left.counts.get(w):
                left.counts[w] -= 1  # the piece itself is no partner; put back below
                rest = Sizes(left.counts)
                r = capacity - w
                f, small = rest.largest(r), rest.smallest(3)
                sure = not f or f == r or len(small) < 2 or sum(small[:2]) > r or (len(small) < 3 or sum(small) > r) and rest.best_pair(r) <= f
                left.counts[w] += 1
                if not sure:
                    break
                have = left.counts[w]
                if not f:
                    n, pattern = have, ((w, 1),)
                elif f == w:
                    n, pattern = have // 2, ((w, 2),)
                else:
                    # What is sure of one w stays so for each further one while w and f last: with fewer pieces left, f is still the largest
                    # that fits, no three fit and no pair is longer.
                    n, pattern = min(have, left.counts[f]), ((w, 1), (f, 1))
                for s, k in pattern:
                    left.take(s, k * n)
                fixed.append((pattern, n))
                changed = True
    return fixed, left.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram: equal open sequences are handled together, so the work grows with the distinct lengths."""
    open_by: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # places left -> sequences
    spaces: list[int] = []

    def put(space: int, pattern: Pattern, n: int) -> None:
        if not open_by[space]:
            insort(spaces, space)
        open_by[space].append((pattern, n))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            k = bisect_left(spaces, s)
            if k == len(spaces):  # nothing open has room: full handfuls first, then the rest
                each = min(capacity // s, n)
                put(capacity - each * s, ((s, each),), n // each)
                n %= each
                continue
            space = spaces[k]
            pattern, m = open_by[space].pop()
            if not open_by[space]:
                del spaces[k]
            each = min(space // s, n)  # the fullest sequence stays the fullest while it has room
            used = min(m, n // each)
            put(space - each * s, (*pattern, (s, each)), used)
            if m > used:
                put(space, pattern, m - used)
            n -= used * each
    return [x for some in open_by.values() for x in some]


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(plan: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, pieces of it in one sequence, first sequence, offset): where the pieces of a length go by rank."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for s, k in pattern:
            rows.append((s, rank[s], rank[s] + n * k - 1, k, sequence, offset))
            rank[s] += n * k
            offset += s * k
        sequence += n
    return rows


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """The columns of ``pieces`` (doc_id, piece, length and any others) with sequence_id and offset.

    Every length must be in 1..capacity. Offsets within a sequence have no gaps. Equal lengths are dealt out by the hash of
    (doc_id, piece), then by these; repeated rows take a place each. An empty frame gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces)
    chunks = pieces.count() // ROWS_TO_NUMBER + 1
    rows = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    counts = rows.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    # At most `capacity` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("_within", within).join(before, ["length", "_chunk"]).withColumn("_rank", F.col("_before") + F.col("_within") - 1)
    # Bounded by the capacity as well: a few entries for each distinct length.
    slots = spark.createDataFrame(places(packing_plan(histogram, capacity)), "_length long, _first long, _last long, _each long, _sequence long, _offset long")
    at = F.col("_rank") - F.col("_first")
    return (ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last")))
            .select(*pieces.columns, (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
                    (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Texts tokenised, cut and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(docs, path, end_id, capacity), capacity)
