"""Threshold-scaled sketches of documents, in DataFrame functions alone.

A sketch keeps every shingle hash below a fixed fraction of the hash range. So the sketch of a union is the union of the sketches, and
containment can be estimated between a page and a book: both keep the same fraction of what they share.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions.arrays import settle
from textguard.llm.common import texts_of

#: One hash of so many is kept.
SCALE = 4
WORDS = 5
#: Documents side by side in one bucket of the walk to the next document, and the most buckets there are (which bounds a broadcast).
BUCKET_ROWS, BUCKETS = 8192, 1_000_000
SPACE = " \t\n\r\x0b\x0c"


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hash of every run of ``words`` lower-cased words; fewer words are one run; no word, no run."""
    clean = F.btrim(F.lower(text), F.lit(SPACE))

    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - F.lit(words), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(words)]))

    # Over a one-element array, so that the words are made once.
    split = F.transform(F.array(F.split(clean, "[ \\t\\n\\r\\x0b\\x0c]+")), runs)
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(split[0])


def sketch(text: Column, scale: int = SCALE, words: int = WORDS) -> Column:
    """array<bigint>, sorted and distinct: the shingle hashes in the lowest 1/scale of the hash range. Null text: as empty."""
    top = -(1 << 63) + (1 << 64) // scale
    kept = F.filter(shingle_hashes(F.coalesce(text, F.lit("")), words), lambda h: h < F.lit(top) if scale > 1 else F.lit(True))
    return F.array_sort(F.array_distinct(kept))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 0 if both are empty."""
    both, common = F.size(F.array_union(a, b)), F.size(F.array_intersect(a, b))
    return F.when(both > 0, common / both).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second holds; 0 if the first sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def as_string(a: Column) -> Column:
    """The sketch as hexadecimal hashes, 16 digits each."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def bucket_of(docs: DataFrame) -> tuple[Column, int]:
    """Buckets of doc_id in ascending order, and how many rows there are.

    256 quantiles of the ids, each cut into equal widths: clustered ids don't meet in one bucket. Only bounds reach the driver.
    """
    shares = [k / 256 for k in range(257)]
    got = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", shares, 10000).alias("q")).first()
    n, bounds = got["n"], sorted(set(got["q"] or [0]))
    parts = max(1, -(-min(n // BUCKET_ROWS + 1, BUCKETS) // len(bounds)))
    if len(bounds) == 1 or n <= BUCKET_ROWS:
        return F.lit(0).cast("long"), n
    marks = F.array(*[F.lit(b).cast("long") for b in bounds])
    group = F.greatest(F.size(F.filter(marks, lambda b: b <= F.col("doc_id"))) - 1, F.lit(0))
    low, high = F.get(marks, group), F.coalesce(F.get(marks, group + 1), F.get(marks, group) + 1)
    part = F.least(F.greatest(F.floor((F.col("doc_id") - low) * F.lit(parts) / (high - low)), F.lit(0)), F.lit(parts - 1))
    return (group * F.lit(parts) + part).cast("long"), n


def with_next(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row next by doc_id (then text); after the last comes the first.

    One shuffle of the rows. ``ids`` holds the doc_id of the same rows: it is read for the bounds, cheaply.
    """
    bucket, _ = bucket_of(ids)
    heads = ids.groupBy(bucket.alias("own")).agg(F.min("doc_id").alias("doc_id"))
    # At most BUCKETS rows, of which each goes to the bucket before its own as well.
    order = Window.orderBy("own")
    before = F.coalesce(F.lag("own").over(order), F.max("own").over(Window.partitionBy()))
    guests = heads.select("doc_id", before.alias("_guest_of"))
    placed = (rows.withColumn("_own", bucket).join(F.broadcast(guests), "doc_id", "left")
              .withColumn("_at", F.explode(F.filter(F.array(F.struct(F.col("_own").alias("bucket"), F.lit(False).alias("guest")),
                                                           F.struct(F.col("_guest_of").alias("bucket"), F.lit(True).alias("guest"))),
                                                    lambda s: s["bucket"].isNotNull()))))
    walk = Window.partitionBy("_at.bucket").orderBy("_at.guest", "doc_id", "text")
    ahead = placed.withColumns({f"next_{c}": F.lead(c).over(walk) for c in columns})
    return ahead.where("not _at.guest").drop("_own", "_guest_of", "_at")


def fingerprint_edits(docs: DataFrame, scale: int = SCALE, words: int = WORDS) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text is the text whose last quarter (rounded down, code points) is replaced by as many first code points of the next
    document by doc_id, or all it has; the next of the last is the first. A fingerprint is a hash of the text, then its sketch.
    Likeness: 1 for equal texts, else the sketches' Jaccard similarity (0 if both are empty); contained_*: the share of the
    document's sketch that the other has. Null text: as empty. Of repeated rows each has the other as its next; rows without doc_id are
    dropped; other columns are ignored; an empty table gives an empty result.
    """
    texts = texts_of(docs)
    own = settle(texts.withColumns({"hashes": sketch(F.col("text"), scale, words), "digest": F.xxhash64("text")}))
    pairs = with_next(own, texts.select("doc_id"), ["text", "hashes", "digest"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    pairs = pairs.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))})
    kept = ["doc_id", "n_chars", "hashes", "digest", "next_hashes", "next_digest"]
    pairs = settle(pairs.select(*kept, "edited"))
    pairs = pairs.select(*kept, sketch(F.col("edited"), scale, words).alias("edited_hashes"), F.xxhash64("edited").alias("edited_digest"),
                         F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    pairs = settle(pairs)

    def named(digest: str, hashes: str) -> Column:
        return F.concat(F.lpad(F.lower(F.hex(digest)), 16, "0"), F.lit(":"), as_string(F.col(hashes)))

    def like(other: str, measure) -> Column:
        return F.when(F.col("digest") == F.col(f"{other}_digest"), F.lit(1.0)).otherwise(measure(F.col("hashes"), F.col(f"{other}_hashes")))

    return pairs.select("doc_id", "n_chars", "edited_sha256", named("digest", "hashes").alias("fingerprint"), named("edited_digest", "edited_hashes").alias("edited_fingerprint"),
                        like("edited", likeness).alias("near_edited"), like("next", likeness).alias("near_next"),
                        like("edited", containment).alias("contained_edited"), like("next", containment).alias("contained_next"))
