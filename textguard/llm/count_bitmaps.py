"""How far the sources of a language diverge, by count-level bitmaps.

Within a group (lang, source) a term's share follows from its count alone. So for each count that occurs in a group there is a bitset over
term ids, and for two groups, the AND of a level of one with a level of the other, counted, says how many terms have that pair of counts.
These joint cells, each times the difference of the two shares, add up to the divergence; terms that a group lacks come by complement.

Term ids are dealt in chunks of terms of similar frequency, so a chunk has few levels and the bitsets are dense. A chunk is one unit of
work for a tile of sources, so neither a large vocabulary nor many sources meet in one task.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import stored

#: A term is kept where so many documents of its language hold it.
LEAST_DOCUMENTS = 30
#: Terms of a chunk, on average.
CHUNK_TERMS = 2048
#: Sources of one side of a tile.
TILE = 32
#: Distinct (group, term) pairs a task counts before it hands them on.
COUNTED_AT_ONCE = 400_000
#: Words of bitsets compared at a time (8 MB).
WORDS_AT_ONCE = 1 << 20
RANKS = 50
#: Bytes: A-Z to a-z, letters and bytes beyond ASCII stay, all others divide terms.
DIVIDE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters and characters beyond ASCII, A-Z in lower case."""
    return raw.translate(DIVIDE).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents). Each group has a row with an empty term besides."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).withColumn("text", F.col("text").cast("binary"))

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            n[b""] = d[b""] = 0
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                some = terms[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()),
                     pa.array([d[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, raw in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms_of(raw)
                n.update(found)
                d.update(set(found))
            if sum(len(n) for n, _ in held.values()) > COUNTED_AT_ONCE:
                yield from rows(held)
        yield from rows(held)

    some = text.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exactly; 0 where no term is kept."""
    return F.expr(f"CASE WHEN {kept} = 0 THEN 0L ELSE 1 + (cast({count} + 5 AS decimal(20,0)) * cast(1000000000 AS decimal(10,0))) div cast({total} + 5 * {kept} AS decimal(20,0)) END")


class Counts:
    """The tables the audit works on.

    ``terms``: lang, term, lang_n, band, bucket, id (in its chunk). ``cells``: lang, source, term, n and the columns of terms.
    ``groups``: lang, source, number (in its language), sources, kept, total, lang_total, p0 (the share of a count of nought).
    """

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS, chunk_terms: int = CHUNK_TERMS):
        all_counts = stored(counted(docs))
        kept = all_counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
        kept = stored(kept.withColumn("band", F.floor(F.log2("lang_n")).cast("int")))
        bands = kept.groupBy("lang", "band").agg(F.ceil(F.count("*") / chunk_terms).alias("buckets"))
        dealt = kept.join(bands, ["lang", "band"]).withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets").cast("int"))
        dealt = dealt.repartition("lang", "band", "bucket")  # the join left a whole band in one task
        place = F.row_number().over(Window.partitionBy("lang", "band", "bucket").orderBy("term")) - 1
        self.terms = stored(dealt.select("lang", "term", "lang_n", "band", "bucket", place.alias("id")))
        self.cells = stored(all_counts.select("lang", "source", "term", "n").join(self.terms, ["lang", "term"]))
        langs = self.terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
        totals = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        in_lang = Window.partitionBy("lang")
        groups = all_counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
        self.groups = stored(groups.withColumns({"number": F.row_number().over(in_lang.orderBy("source")) - 1, "sources": F.count("*").over(in_lang)}).withColumn(
            "p0", share("0", "total", "kept")))

    def chunks(self) -> DataFrame:
        """lang, band, bucket, size: every chunk of terms, and an empty one for each language, so that all its sources meet."""
        held = self.terms.groupBy("lang", "band", "bucket").agg(F.count("*").cast("int").alias("size"))
        return held.unionByName(self.groups.select("lang").distinct().select("lang", F.lit(-1).alias("band"), F.lit(0).alias("bucket"), F.lit(0).alias("size")))


def bitmaps(counts: Counts) -> DataFrame:
    """One row for each source and chunk: size (terms of the chunk), counts and their shares, and ``bits``, a bitset of ``size`` term ids for each count.

    A source without any term of the chunk has a row without levels. The ids of a row are at most a chunk's.
    """
    levels = counts.cells.join(counts.groups.select("lang", "source", "total", "kept"), ["lang", "source"]).withColumn("p", share("n", "total", "kept"))
    levels = levels.groupBy("lang", "band", "bucket", "source").agg(F.collect_list(F.struct("n", "p", "id")).alias("seen"))
    rows = counts.chunks().join(counts.groups.select("lang", "source", "number", "sources", "p0"), "lang").join(levels, ["lang", "band", "bucket", "source"], "left")
    names = ["lang", "band", "bucket", "size", "source", "number", "sources", "p0"]
    rows = rows.select(*names, *[F.coalesce(F.expr(f"cast(seen.{c} AS array<long>)"), F.expr("cast(array() AS array<long>)")).alias(c) for c in ("n", "p", "id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bitset(*[np.asarray(batch.column(c)[k].values) for c in ("n", "p", "id")], batch.column("size")[k].as_py()) for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.binary())],
                names=[*names, "counts", "shares", "bits"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(run, f"{kinds}, counts array<long>, shares array<long>, bits binary")


def bitset(n: np.ndarray, p: np.ndarray, ids: np.ndarray, size: int) -> tuple[list[int], list[int], bytes]:
    """(counts, shares, bitsets) of one group's terms in one chunk; a bitset is whole 64-bit words."""
    level, first, place = np.unique(n, return_index=True, return_inverse=True)
    flags = np.zeros((len(level), -(-size // 64) * 64), bool)
    flags[place, ids] = True
    return level.tolist(), p[first].tolist(), np.packbits(flags, axis=1, bitorder="little").tobytes()


class Stack:
    """The levels of several groups of one chunk, one below the other."""

    def __init__(self, groups: list[dict], size: int):
        words = -(-size // 64)
        self.shares = np.concatenate([np.asarray(g["shares"], np.int64) for g in groups])
        self.bits = np.concatenate([np.frombuffer(g["bits"], "<u8").reshape(len(g["shares"]), words) for g in groups])
        self.owner = np.repeat(np.arange(len(groups)), [len(g["shares"]) for g in groups])
        self.p0 = np.array([g["p0"] for g in groups], np.int64)
        self.sizes = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.held = np.zeros(len(groups), np.int64)
        np.add.at(self.held, self.owner, self.sizes)


def divergences(one: dict, many: Stack, size: int) -> np.ndarray:
    """The sum over the chunk's terms of the difference in share between one group and each of ``many``."""
    mine = Stack([one], size)
    out = np.zeros(len(many.p0), np.int64)
    both = np.zeros(len(many.p0), np.int64)  # terms that both groups hold
    met = np.zeros(len(many.shares), np.int64)  # of each level of the others, terms that this group holds too
    step = max(1, WORDS_AT_ONCE // max(1, many.bits.size))
    for at in range(0, len(mine.shares), step):
        shares, sizes = mine.shares[at:at + step], mine.sizes[at:at + step]
        cells = np.bitwise_count(mine.bits[at:at + step, None, :] & many.bits[None, :, :]).sum(axis=2, dtype=np.int64)
        np.add.at(out, many.owner, (cells * np.abs(shares[:, None] - many.shares[None, :])).sum(axis=0))
        of_group = np.zeros((len(shares), len(many.p0)), np.int64)
        np.add.at(of_group.T, many.owner, cells.T)
        out += ((sizes[:, None] - of_group) * np.abs(shares[:, None] - many.p0[None, :])).sum(axis=0)
        both += of_group.sum(axis=0)
        met += cells.sum(axis=0)
    np.add.at(out, many.owner, (many.sizes - met) * np.abs(mine.p0[0] - many.shares))
    return out + (size - mine.held[0] - many.held + both) * np.abs(mine.p0[0] - many.p0)


def pairs(levels: DataFrame) -> DataFrame:
    """lang, source, item, value: each ordered pair of sources of a language with the sum of differences over all kept terms.

    Sources lie in blocks of ``TILE``; a tile of two blocks and a chunk is one unit of work. All pairs of sources are what is asked for.
    """
    block = F.floor(F.col("number") / TILE).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / TILE).cast("int")))
    tiled = levels.withColumn("block", block).withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    key = ["lang", "i", "j", "band", "bucket"]
    dealt = tiled.select(*key, "size", "block", "number", "source", "p0", "shares", "bits").repartition(*key).sortWithinPartitions(*key, "number")

    def tile(rows: list[dict]) -> Iterator[tuple[str, str, int]]:
        i, j, size = rows[0]["i"], rows[0]["j"], rows[0]["size"]
        left, right = [r for r in rows if r["block"] == i], [r for r in rows if r["block"] == j]
        for k, one in enumerate(left):
            others = right[k + 1:] if i == j else right
            if others:
                for r, value in zip(others, divergences(one, Stack(others, size), size).tolist(), strict=True):
                    yield one["source"], r["source"], value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, sums, lang = None, [], Counter(), None

        def out() -> pa.RecordBatch:
            names = list(sums)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.string()),
                                               pa.array([sums[n] for n in names], pa.int64())], names=["lang", "source", "item", "value"])

        def add() -> None:
            for a, b, value in tile(rows) if rows else ():
                sums[a, b] += value

        for batch in batches:
            for row in batch.to_pylist():
                here = tuple(row[k] for k in key)
                if here != at:
                    add()
                    rows = []
                    if at is None or here[:3] != at[:3]:
                        if sums:
                            yield out()
                        sums, lang = Counter(), here[0]
                    at = here
                rows.append(row)
        add()
        if sums:
            yield out()

    half = dealt.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return half.select("lang", "value", both.alias("way")).select("lang", "way.source", "way.item", "value")


def terms(counts: Counts) -> DataFrame:
    """lang, source, item, value: the terms a source has more of than its language, and by how much."""
    rows = counts.cells.join(counts.groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    rows = rows.withColumns({"p": share("n", "total", "kept"), "q": share("lang_n", "lang_total", "kept")}).where("n > 0 AND p > q")
    return rows.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other one of its language, and its ``ranks`` most typical terms.

    Null text, lang and source count as ''. Every row is a document, repeated ones too; doc_id and other columns are not read. A
    source without any term takes part with counts of nought; where a language keeps no term, its pairs have the value 0. Equal
    values are ranked by item in UTF-8. An empty table gives an empty result.
    """
    counts = Counts(docs, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    far = pairs(stored(bitmaps(counts))).withColumn("rank", F.row_number().over(order))
    typical = terms(counts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return far.withColumn("part", F.lit("pair")).unionByName(typical.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
