"""Near-duplicate documents by b-bit MinHash.

Map side, each document's set of word shingles gives ``MINIMA`` minima. Groups of them form band keys; their low ``BITS`` bits, packed,
are the signature. Documents that share a band key are candidates; the share of equal signature entries, corrected for chance
collisions, estimates their similarity; what may reach the threshold is confirmed on the full sets.

Nothing is listed pair by pair within a group. Equal sets count once (a class with a representative). Each band bucket then compares its
members with one leader only. What this leaves open are buckets that still hold several components. Their documents are posted under
their rarest shingles, as many as a partner that reaches the threshold must share one of (prefix filter, exact); shingles that only one
component has count as rarest of all and are not posted. In a list, only documents outside its largest component look for partners, so
a family that is one component already is not paired with itself. A document that is not linked to its family's leader has so many
shingles of its own that the family's common ones do not come into its prefix.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import only_cache, stored, texts_of

MINIMA, BITS = 128, 4
#: Rows of a band. At similarity 0.85 a pair shares none of the 32 bands with probability 6e-11.
BAND_ROWS = 4
#: Standard deviations that the estimate may fall short of the threshold before a pair is dropped unconfirmed.
SLACK = 6.0
#: Word hashes a worker remembers (some 40 MB); to make one anew is cheap.
HASHED_WORDS = 200_000
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


def word_hashes(words: list[bytes]) -> np.ndarray:
    held = only_cache("hashes").setdefault("words", WordHashes())
    if len(held) > HASHED_WORDS:
        held.clear()
    return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str, words: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; fewer words are one run; no word, no run.

    Words are what stands between ASCII white space, A-Z lowered.
    """
    h = word_hashes(text.encode("utf-8").lower().split())
    if not len(h):
        return h
    k = min(words, len(h))
    s = np.full(len(h) - k + 1, (k * MIX[3]) % 2**64, np.uint64)
    for j in range(k):
        s = (s ^ h[j:len(h) - k + 1 + j]) * np.uint64(MIX[j % 3])
        s ^= s >> np.uint64(29)
    return np.unique(s)


def minima(hashes: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """n minima (uint32) of a non-empty set."""
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 2**32, n, np.uint32)[:, None] for _ in range(2))
    a |= np.uint32(1)
    x, low = (hashes >> np.uint64(32)).astype(np.uint32), None
    for k in range(0, len(x), 2048):
        part = (x[None, k:k + 2048] * a + b).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    key = (np.arange(1, MINIMA // BAND_ROWS + 1, dtype=np.uint64)) * np.uint64(MIX[0])
    for part in low.reshape(-1, BAND_ROWS).T.astype(np.uint64):
        key = (key ^ part) * np.uint64(MIX[1])
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signature(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, packed: BITS / 64 longs for each."""
    bits = (low[:, None] >> np.arange(BITS, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).view(np.int64)


SKETCH = "doc_id long, n_shingles long, high long, low long, signature array<long>, bands array<long>"


def sketches(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per document: size and 128-bit digest of its shingle set, signature, band keys (both empty without a shingle). Map-only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low, signs, bands = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                d = xxhash.xxh3_128_digest(s.tobytes())
                least = minima(s) if len(s) else np.empty(0, np.uint32)
                n.append(len(s))
                high.append(int.from_bytes(d[:8], "little", signed=True))
                low.append(int.from_bytes(d[8:], "little", signed=True))
                signs.append(signature(least) if len(s) else np.empty(0, np.int64))
                bands.append(band_keys(least) if len(s) else np.empty(0, np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(signs, longs), pa.array(bands, longs)],
                                             names=["doc_id", "n_shingles", "high", "low", "signature", "bands"])

    return texts_of(docs).mapInArrow(run, SKETCH)


def estimate(a: Column, b: Column, n: int = MINIMA) -> Column:
    """Similarity from two packed signatures: the share of equal entries, by bit counts, less what chance collisions give."""
    differing = F.lit(0)
    for k in range(n * BITS // 64):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        any_bit = x
        for j in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, j))
        ones = sum(1 << (BITS * j) for j in range(64 // BITS))
        differing = differing + F.bit_count(any_bit.bitwiseAND(F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones)))
    chance = 2.0**-BITS
    return (1 - differing / F.lit(float(n)) - chance) / (1 - chance)


def least_estimate(threshold: float, n: int = MINIMA) -> float:
    equal = threshold + (1 - threshold) * 2.0**-BITS
    return threshold - SLACK * (equal * (1 - equal) / n) ** 0.5 / (1 - 2.0**-BITS)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in ``edges`` (a, b), by alternating large and small stars."""
    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both if large else both.where("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = near.join(least, "u")
        moved = joined.where("v > u") if large else joined
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = mark(edges)
    while seen[0]:
        edges = stored(stars(stars(edges, True), False))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold_percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= threshold_percent * union holds on the full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, big = (s, t) if len(s) < len(t) else (t, s)
                at = np.searchsorted(big, small)
                common = int((big[np.minimum(at, len(big) - 1)] == small).sum())
                keep.append(100 * common >= threshold_percent * (len(s) + len(t) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


SHINGLES = "rep long, part int, n_shingles int, component long, shingle long"


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set; part tells the sets of one id apart."""
    for batch in batches:
        for rep, component, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            values, part = np.frombuffer(s.as_buffer(), np.int64), xxhash.xxh32_intdigest(s.as_buffer()) >> 1
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rep)), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, n, np.int32)), pa.array(np.full(n, component)), pa.array(values)],
                                             names=["rep", "part", "n_shingles", "component", "shingle"])


def prefixes(members: DataFrame, sets: DataFrame, threshold_percent: int) -> DataFrame:
    """The postings (rep, component, n_shingles, shingle, pos) of the documents ``members`` (rep, component).

    Shingles are ordered by whether two components have them, by how many documents do, and by value. pos is a shingle's place in its
    document's order; postings go up to the last place at which the first shingle shared with a partner may stand. An id with several
    texts has the postings of each; repeated rows count once.
    """
    each = sets.join(members, "rep").select("rep", "component", "shingles").mapInArrow(one_by_one, SHINGLES)
    across = (each.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("df"))
              .where("x <> y").select("shingle", "df"))
    ordered = each.join(across, "shingle").groupBy("rep", "part", "n_shingles").agg(F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("s"))
    # Too few shingles in common with any other component: alone for sure.
    own = ordered.withColumn("least", F.expr(f"cast(({threshold_percent} * n_shingles + 99) div 100 AS int)")).where("size(s) >= least").join(members, "rep")
    posted = own.select("rep", "component", "n_shingles", F.expr("n_shingles - size(s)").alias("own"), F.posexplode(F.expr("slice(s, 1, size(s) - least + 1)")).alias("at", "e"))
    return posted.select("rep", "component", "n_shingles", F.col("e.shingle").alias("shingle"), (F.col("own") + F.col("at")).alias("pos"))


def across_components(postings: DataFrame, threshold_percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of different components that share a posting at places where the threshold can still be reached.

    Every linked pair of different components is among them. Partners are looked for by size, first among the sizes that a list has.
    """
    held = postings.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    major = held.groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    lists = stored(postings.join(major, "shingle"))
    a = lists.where("component <> major").select("shingle", "major", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n_shingles").alias("na"), F.col("pos").alias("pa"))
    b = lists.select("shingle", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n_shingles").alias("nb"), F.col("pos").alias("pb"))
    needed = f"({threshold_percent} * (na + nb) + {99 + threshold_percent}) div {100 + threshold_percent}"
    sizes = b.groupBy("shingle", "nb").agg(F.min("pb").alias("first"))
    asked = a.join(sizes, "shingle").withColumn("needed", F.expr(needed)).where("least(na, nb) >= needed and pa <= na - needed and first <= nb - needed")
    met = asked.join(b, ["shingle", "nb"]).where("ca <> cb and pb <= nb - needed and (cb = major or a > b)")
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def joined(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rep, component of all ``rows`` under ``links``."""
    return stored(rows.select("rep").join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))


def near_duplicates(docs: DataFrame, words: int = 5, threshold_percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id, component_id, kept.

    Two documents are linked if 100 * |intersection| >= threshold_percent * |union| of their shingle sets. component_id is the
    smallest doc_id reachable over links, itself included; kept marks it. class_id is the smallest doc_id with the same set.
    Null or empty texts and texts without a word have an empty set and are linked with nothing. Rows with the same doc_id count as one
    document (linked to one another); rows without doc_id are dropped; other columns are ignored.
    """
    made = stored(sketches(docs, words))
    some = made.where("n_shingles > 0")
    classes = some.groupBy("high", "low").agg(F.min("doc_id").alias("rep"))
    made = stored(made.join(classes, ["high", "low"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id"))))
    reps = made.where("n_shingles > 0 and doc_id = rep").select("rep", "n_shingles", "signature", "bands")

    # Buckets of at least two different representatives, and who is in them. The leader is the first by id.
    posted = reps.select(F.explode("bands").alias("key"), "rep")
    shared = posted.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader <> last").drop("last")
    posted = stored(posted.join(shared, "key"))
    signs = stored(reps.select("rep", "n_shingles", "signature").join(posted.select("rep").distinct(), "rep").distinct())

    def set_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in found], pa.binary())], names=["rep", "shingles"])

    sets = stored(texts_of(docs).join(signs.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(set_of, "rep long, shingles binary"))

    near = least_estimate(threshold_percent / 100)
    likely = estimate(F.col("sa"), F.col("sb")) >= near

    def side(c: str) -> DataFrame:
        return signs.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))

    # Members against their buckets' leaders.
    led = posted.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    sized = 100 * F.least("na", "nb") >= threshold_percent * F.greatest("na", "nb")
    tested = stored(led.join(side("a"), "a").join(side("b"), "b").where(sized & likely).select("a", "b"))
    links = stored(confirmed(tested, sets, threshold_percent))
    comp = joined(signs.select("rep").distinct(), links)

    # Buckets that still hold several components.
    placed = posted.select("key", "rep").join(comp, "rep")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    members = stored(placed.join(mixed, "key").select("rep", "component").distinct())
    rest = across_components(stored(prefixes(members, sets, threshold_percent)), threshold_percent)
    rest = stored(rest.join(side("a"), "a").join(side("b"), "b").where(likely).select("a", "b"))
    more = stored(confirmed(rest, sets, threshold_percent))
    # These links join whole components.
    first, second = (comp.select(F.col("rep").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    over = components(more.join(first, "a").join(second, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    comp = comp.join(over.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("rep", F.coalesce("root", "component").alias("component"))

    out = made.join(comp, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", F.col("rep").alias("class_id"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, threshold_percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_duplicates`` marks as kept: one document of each group. Of rows with the same doc_id one stays."""
    kept = near_duplicates(docs, words, threshold_percent).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
