"""Conversation context (S5, W1-W3): a message and the few before it.

A conversation may hold a third of all rows, so no operator here puts a conversation into one
task. Rows are worked on in chunks of consecutive turns, keyed by (conversation, chunk); what a
chunk needs from before it, at most ``n`` rows, is carried over from the chunks that precede it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators.normalize import normalize

# Turns per chunk. A chunk is one window group: bounded, and large enough that carrying a few
# rows across its edge costs nothing.
CHUNK = 50_000


def lookback(df: DataFrame, key: str, order: str, n: int, value: str, out: str, chunk: int = CHUNK,
             tie: str | None = None, source: DataFrame | None = None,
             prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``out``: the last ``n`` values before each row of its key, oldest first, nulls kept.

    ``order`` is an integer that grows along the key; gaps are fine, and ``tie`` settles equal
    values. Every non-empty chunk has at least one row, so the ``n`` chunks before a chunk hold
    everything it can look back to.

    Where ``value`` is costly, give the rows it is made from as ``source`` and the making as
    ``prepare``: then only the few rows that are carried over a chunk's edge are made twice.
    """
    along = [order, tie] if tie else [order]
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    within = Window.partitionBy(key, "_chunk").orderBy(*along)
    df = df.withColumns({
        "_seen": F.collect_list(F.struct(F.col(value).alias("v"))).over(within.rowsBetween(-n, -1)),
        "_place": F.row_number().over(within),
    })
    # Chunks that another chunk of the key follows. Mostly there are none, and then all that is
    # left of this branch is a count over two columns.
    raw = (df if source is None else source.withColumn("_chunk", F.floor(F.col(order) / chunk)))
    following = F.lead("_chunk").over(Window.partitionBy(key).orderBy("_chunk"))
    followed = (raw.groupBy(key, "_chunk").agg(F.count("*").alias("_n")).withColumn("_next", following)
                .filter("_next IS NOT NULL").select(key, "_chunk"))
    last = Window.partitionBy(key, "_chunk").orderBy(*[F.col(c).desc() for c in along])
    ends = (raw.drop("_seen", "_place").join(followed, [key, "_chunk"], "left_semi")
            .withColumn("_back", F.row_number().over(last)).filter(F.col("_back") <= n).drop("_back"))
    ends = prepare(ends) if prepare else ends
    entry = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(along)], F.col(value).alias("v"))
    tails = ends.groupBy(key, "_chunk").agg(F.array_sort(F.collect_list(entry)).alias("_tail"))

    # Each chunk, and the tails of the n chunks before it.
    chunks = raw.groupBy(key, "_chunk").agg(F.count("*").alias("_n")).drop("_n").join(tails, [key, "_chunk"], "left")
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(-n, -1)
    carried = (chunks.withColumn("_prev", F.flatten(F.collect_list("_tail").over(before)))
               .filter(F.size("_prev") > 0)
               .select(key, "_chunk", F.expr(f"slice(_prev, greatest(size(_prev) - {n - 1}, 1), {n}).v").alias("_carry")))
    filled = F.expr(
        f"CASE WHEN _carry IS NULL OR _place > {n} THEN _seen.v ELSE "
        f"slice(concat(_carry, _seen.v), greatest(size(_carry) + size(_seen) - {n - 1}, 1), {n}) END")
    return df.join(carried, [key, "_chunk"], "left").withColumn(out, filled).drop("_chunk", "_carry", "_place", "_seen")


def newest(df: DataFrame, key: str, order: str, n: int, tie: str | None = None) -> DataFrame:
    """The newest ``n`` rows of every key with their ``rank`` (1 is the newest).

    Spark limits each group before the shuffle as well as after it, so a hot key sends n rows from each task.
    """
    down = [F.col(c).desc() for c in ([order, tie] if tie else [order])]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*down))).filter(F.col("rank") <= n)


def context_window(df: DataFrame, n: int = 12, key: str = "conv_id", order: str = "turn", text: str = "text",
                   out: str = "context", chunk: int = CHUNK) -> DataFrame:
    """The last twelve earlier messages of the conversation, oldest first."""
    return lookback(df, key, order, n, text, out, chunk)


def rewrite_context(df: DataFrame, n: int = 8, width: int = 300, **keys) -> DataFrame:
    """The last eight lines, 300 characters each."""
    short = df.withColumn("_line", F.substring(F.col(keys.pop("text", "text")), 1, width))
    return lookback(short, keys.pop("key", "conv_id"), keys.pop("order", "turn"), n, "_line", "rewrite_context",
                    **keys).drop("_line")


def with_context(df: DataFrame, key: str = "conv_id", order: str = "turn", chunk: int = CHUNK, text: str = "text",
                 source: DataFrame | None = None) -> DataFrame:
    """Adds what the rule tier reads of the context to normalised messages: its size (up to
    twelve) and the word sets of the last six messages.

    ``source`` is the frame ``df`` was normalised from; with it, normalisation is not repeated.
    """
    def long_words(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_words", F.expr("array_distinct(filter(tokens, w -> char_length(w) > 2))"))

    prepare = None if source is None else lambda raw: long_words(normalize(raw, text))
    df = lookback(long_words(df), key, order, 12, "_words", "_context", chunk, source=source, prepare=prepare)
    return df.withColumns({
        "context_size": F.size("_context"),
        "context_words": F.expr("slice(_context, greatest(size(_context) - 5, 1), 6)"),
    }).drop("_words", "_context")


def conversation_source(df: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text",
                        limit: int = 12) -> DataFrame:
    """Trimmed lines of 2 to 500 characters, first of each repeat, the last twelve.

    First occurrences come from a partially aggregated group-by.
    """
    line = T.trim_all(F.col(text))
    lines = df.select(key, order, line.alias("line")).filter(F.char_length("line").between(2, 500))
    first = lines.groupBy(key, "line").agg(F.min(order).alias(order))
    return newest(first, key, order, limit).select(key, order, "line")
