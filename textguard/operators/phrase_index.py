"""Phrase lists of any size as a table, found by their words in a row.

A text is read once, where it lies. All its runs of as many words as some phrase has are hashed, and a bitmap of the phrases' hashes, of bounded size
however long the list, tells which runs may be phrases. Only those leave the task, as strings, and meet the phrases in an equi-join: equal strings are the same
phrase, so the texts themselves are neither stored nor shuffled. The lists of :mod:`textguard.operators.phrases` are some 500 phrases and part
of the plan; here phrases are rows, so a list may have hundreds of thousands.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from textguard.operators import phrases as P
from textguard.operators.normalize import normalize

#: A run of words with more than this share of all (text, run) rows is spread over several tasks. There can be no more such runs than 1 / share.
HOT_SHARE = 0.001
#: Bits of the bitmap: some 256 for each phrase, at least and at most so many (as powers of two).
LEAST_BITS, MOST_BITS = 22, 27
#: A longer run is hashed only where its first words may begin a phrase.
HEAD = 4
#: Bytes of text hashed at a time; a longer text is hashed alone.
CHUNK = 1 << 20
#: Bytes are the digits of a number to this base, words those of a number to the other, both modulo 2**64.
BYTE_BASE, WORD_BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, np.uint64(0xBF58476D1CE4E5B9)


def builtin_phrases(spark: SparkSession) -> DataFrame:
    """The built-in lists as a phrase table: list, phrase, evasive, needle."""
    rows = [(name, p, name in P.EVASIVE, P.needle(p)) for name, terms in P.PHRASE_LISTS.items() for p in dict.fromkeys(terms)]
    return spark.createDataFrame(rows, "list string, phrase string, evasive boolean, needle string")


def with_needles(phrases: DataFrame, typos: dict[str, str] | None = None) -> DataFrame:
    """Adds ``needle``: each phrase in the padded form a text has after normalising, so "you're dead" also finds "ur dead"."""
    return normalize(phrases.select("list", "phrase", "evasive"), "phrase", typos).select("list", "phrase", "evasive", F.col("ctext").alias("needle"))


def pairs(words: str) -> str:
    """The neighbouring words of an array, two by two."""
    return f"array_compact(zip_with({words}, slice({words}, 2, greatest(size({words}), 1)), (a, b) -> concat(a, ' ', b)))"


def needle_parts(needle: str = "needle") -> str:
    """The parts a padded phrase may be posted under: its pairs, or its only word."""
    words = f"split(trim({needle}), ' ')"
    return f"array_distinct(CASE WHEN size({words}) > 1 THEN {pairs(words)} ELSE {words} END)"


def rarest_parts(needles: DataFrame, counts: DataFrame) -> DataFrame:
    """The postings (needle, part, n): each needle under the part fewest texts have, ties to the first in order.

    ``counts`` is (part, n). A needle with a part that no text has can be in no text and gets no posting.
    """
    parts = needles.select("needle").distinct().select("needle", F.explode(F.expr(needle_parts())).alias("part"))
    ranked = parts.join(counts, "part", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("_r"))
    return ranked.filter("_r.n > 0").select("needle", "_r.part", "_r.n")


def stored(df: DataFrame, path: str) -> DataFrame:
    """The frame, written and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of bytes, and of its inverse."""
    up, down = np.full(n, BYTE_BASE, np.uint64), np.full(n, pow(BYTE_BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the blanks are in the bytes, and a hash of what is between each two neighbours."""
    blanks = np.flatnonzero(data == 32)
    up, down = powers(max(CHUNK, 1 << len(data).bit_length()))
    before = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=before[1:])
    first, last = blanks[:-1] + 1, blanks[1:]
    hashes = (before[last] - before[first]) * down[np.minimum(first, len(down) - 1)]
    return blanks, (hashes ^ (hashes >> np.uint64(29))) * MIX + np.uint64(1)  # an empty word counts too


def run_hashes(words: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each size with the hashes of the runs of so many words, by their first word. The sizes ascend."""
    base, run, n = np.uint64(WORD_BASE), words, 1
    for size in sizes:
        while n < size and len(run):
            run = run[:-1] * base + words[n:]
            n += 1
        yield size, run


def place(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The hashes' places in a bitmap of 2**bits."""
    return (hashes ^ (hashes >> np.uint64(32))) * MIX >> np.uint64(64 - bits)


def hit(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of the hashes the bitmap has."""
    at = place(hashes, bits)
    return np.flatnonzero(bitmap[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


def runs_met(data: np.ndarray, borders: np.ndarray, bitmap: np.ndarray, bits: int, sizes: list[int]) -> Iterator[tuple[int, bytes]]:
    """(text, run) for the runs of words that the bitmap knows. A run stands between two blanks of one text; ``borders`` are where the texts begin, and the end."""
    blanks, words = word_hashes(data)
    text = np.searchsorted(borders, blanks, "right") - 1
    short, long = [n for n in sizes if n <= HEAD], [n for n in sizes if n > HEAD]
    raw = data.tobytes()

    def met(at: np.ndarray, n: int) -> set[tuple[int, bytes]]:
        at = at[text[at] == text[at + n]]
        return {(t, raw[x:y]) for t, x, y in zip(text[at].tolist(), (blanks[at] + 1).tolist(), blanks[at + n].tolist())}

    for n, run in run_hashes(words, short):
        yield from met(hit(bitmap, run, bits), n)
    if long:
        (_, run), = run_hashes(words, [HEAD])
        starts = hit(bitmap, ~run, bits)
        run, base, n = run[starts], np.uint64(WORD_BASE), HEAD
        for size in long:
            while n < size:
                keep = starts + n < len(words)
                starts, run = starts[keep], run[keep]
                run = run * base + words[starts + n]
                n += 1
            yield from met(starts[hit(bitmap, run, bits)], size)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column without nulls, one after the other, and where each begins, with the end."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return held[borders[0]:borders[-1]], borders - borders[0]


def chunks(borders: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of CHUNK bytes at most in all, or a single one."""
    a, n = 0, len(borders) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(borders, borders[a] + CHUNK, "right")) - 1)
        yield a, b
        a = b


def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each padded phrase: how many words it has, its hash, and that of its first HEAD words."""
    for batch in batches:
        data, borders = utf8(batch.column(0))
        for a, b in chunks(borders):
            blanks, words = word_hashes(data[borders[a]:borders[b]])
            first = np.searchsorted(blanks, borders[a:b + 1] - borders[a])
            sizes = np.diff(first) - 1
            whole, heads = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            for size, run in run_hashes(words, sorted({HEAD, *sizes.tolist()})):
                for out, which in ((whole, sizes == size), (heads, np.minimum(sizes, HEAD) == size)):
                    out[which] = run[first[:-1][which]]
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(whole.view(np.int64)), pa.array(heads.view(np.int64))], names=["size", "whole", "head"])


def known_runs(rows: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """The bitmap of the phrases and of their first HEAD words, the binary logarithm of its bits, and how many words a phrase may have."""
    bits = min(max((256 * rows.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashed(batches):
            size, whole, head = (np.asarray(c) for c in batch.columns)
            long = size > HEAD
            at = place(np.r_[whole.view(np.uint64), ~head[long].view(np.uint64)], bits)  # inverted, a beginning is not taken for a phrase
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[size, size[long]]), pa.array(at.view(np.int64))], names=["size", "at"])

    found = rows.select(F.concat(F.lit(" "), "run", F.lit(" "))).mapInArrow(places, "size long, at long")
    # Spark numbers the bits of a bucket from 1.
    blocks = found.select("size", F.expr("bitmap_bucket_number(at + 1)").alias("block"), F.expr("bitmap_bit_position(at + 1)").alias("bit"))
    bitmap, sizes = np.zeros(max(1 << bits, 32768) // 8, np.uint8), set()
    for block, held, of in blocks.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)"), F.collect_set("size")).collect():
        bitmap[(block - 1) * 4096:block * 4096] = np.frombuffer(held, np.uint8)
        sizes.update(of)
    return bitmap, bits, sorted(sizes)


def runs_of(texts: DataFrame, known: tuple[np.ndarray, int, list[int]]) -> DataFrame:
    """(_key, run, plain): the runs of words of each padded text that may be phrases, and whether the form itself has them or but the joined one.

    ``texts`` has _key, _form and _joined. A row may come more than once where rows share a key, and with both values of ``plain``.
    """
    bitmap, bits, sizes = known
    kind = StructType([StructField("_key", texts.schema["_key"].dataType), StructField("run", StringType()), StructField("plain", BooleanType())])
    held = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, plain in ((1, True), (2, False)):
                data, borders = utf8(batch.column(k))
                for a, b in chunks(borders):
                    found = list(runs_met(data[borders[a]:borders[b]], borders[a:b + 1] - borders[a], held.value, bits, sizes))
                    if found:
                        rows = pa.array([a + t for t, _ in found])
                        runs = pa.array([r for _, r in found], pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), runs, pa.array([plain] * len(found))], names=kind.names)

    return texts.mapInArrow(run, kind)


def phrase_matches(df: DataFrame, phrases: DataFrame, key: str, path: str, form: str = "ctext", joined: str | None = "cjoined") -> DataFrame:
    """L3 for a table of phrases: one row (key, list, phrase) for each phrase that a text has as whole words.

    ``phrases`` has list, phrase, evasive and needle (see :func:`with_needles`); ``form`` is the padded text, and evasive phrases are also looked up in
    ``joined``, where spelled-out letters are glued back. The phrases, and the runs of words that may be phrases, are written below the folder ``path`` and read
    from there, so whatever makes the texts (normalising is the dear part) runs once.

    Texts without a key take no part; rows that share a key are parts of one text; a null text has no words. Null phrases, and phrases without
    a word, are nowhere; a null ``evasive`` is false; repeated phrases count once a list. Other columns are not looked at.
    """
    rows = phrases.select("list", "phrase", F.coalesce("evasive", F.lit(False)).alias("evasive"), "needle").filter("phrase IS NOT NULL AND trim(needle) != ''")
    rows = stored(rows.select("list", "phrase", "evasive", F.regexp_replace("needle", "^ | $", "").alias("run")).distinct(), f"{path}/phrases")
    plain, other = F.coalesce(F.col(form), F.lit("")), F.lit("")
    if joined and rows.filter("evasive").limit(1).count():
        other = F.when(F.coalesce(F.col(joined), F.lit("")) != plain, F.col(joined))  # read only where it differs
    texts = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), plain.alias("_form"), F.coalesce(other, F.lit("")).alias("_joined"))
    runs = stored(runs_of(texts, known_runs(rows)), f"{path}/runs")
    counts = stored(runs.groupBy("run").agg(F.count("*").alias("n")), f"{path}/counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    share = max(int(total * HOT_SHARE), 1000)

    # Hot runs hold over HOT_SHARE of the rows each, so at most a thousand are broadcast, and their splits add up to two thousand at most.
    hot = counts.filter(F.col("n") > share).select("run", F.ceil(F.col("n") / share).cast("int").alias("splits"))
    postings = rows.join(counts, "run")
    postings = postings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / share).cast("int") - 1))).drop("n")
    salted = runs.join(F.broadcast(hot), "run", "left").withColumn("salt", F.pmod(F.xxhash64("_key"), F.coalesce("splits", F.lit(1))).cast("int"))
    found = salted.join(postings, ["run", "salt"]).filter("plain OR evasive").select(F.col("_key").alias(key), "list", "phrase")
    return found.dropDuplicates([key, "list", "phrase"])
