"""Language-model scores of documents from a weighted backoff automaton learnt from the corpus.

A document is its words between a start and an end mark. Smoothed n-grams are the automaton: a state for every context seen in
training, an arc for every word seen after it, and a failure arc to the next shorter context. One walk from left to right carries the
state and adds up log probabilities:

    P(w | context) = (c(context w) + MU * P(w | shorter context)) / (c(context) + MU)

ending at the additively smoothed unigram. An arc weighs log P; a failure arc weighs log MU / (c(context) + MU).

The counts may be as large as the corpus, so no task holds them all. Documents are dealt to chunks by id. Each chunk lists its distinct
n-grams once, as sorted hashes with its own training counts; buckets of the hash range add up the counts of all chunks and answer each
chunk with the totals of what it listed, in its order; each chunk then builds the part of the automaton that its texts can reach.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import stored, texts_of

ORDER, MU, ADDED = 2, 100.0, 0.1
#: Code points of text in a chunk and behind a bucket, about: what one task holds at a time.
CHUNK_CHARS, BUCKET_CHARS = 16_000_000, 12_000_000
#: Tokens that one lane of the walk reads.
SEGMENT = 256
START, END = 0, 1  # local ids of the marks
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TAG = np.uint64(7)  # the low bits of an n-gram's hash are its order, 0 for the start mark


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


class Chunk:
    """The token ids of some documents, and their distinct n-grams as hashes."""

    def __init__(self, order: int):
        self.order, self.words, self.docs, self.tokens = order, {b"\0start": START, b"\0end": END}, [], []

    def add(self, doc_id: int, text: str) -> None:
        words = self.words
        self.tokens.append(np.array([START, *[words.setdefault(w, len(words)) for w in text.encode("utf-8").lower().split()], END], np.int64))
        self.docs.append(doc_id)

    def close(self) -> None:
        """Lay the documents out one after the other and number their n-grams: ``keys[n]`` holds, sorted, prefix number * words + last word."""
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.ids = np.concatenate(self.tokens)
        self.tokens = []
        first = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.at = np.arange(len(self.ids)) - np.repeat(first, self.lengths)
        trained = np.repeat(np.array([not held_out(d) for d in self.docs]), self.lengths)
        size = self.size = len(self.words)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, size) & ~TAG | np.uint64(1)
        hashes[START] &= ~TAG
        self.keys, self.hashes = {1: np.arange(size)}, {1: hashes}
        self.counts = {1: np.bincount(self.ids[trained], minlength=size)}
        number = self.ids
        for n in range(2, self.order + 1):
            valid = np.flatnonzero(self.at >= n - 1)
            key = number[valid - 1] * size + self.ids[valid]
            if n < self.order:
                self.keys[n], back = np.unique(key, return_inverse=True)
                self.counts[n] = np.bincount(back[trained[valid]], minlength=len(self.keys[n]))
                number = np.zeros(len(self.ids), np.int64)
                number[valid] = back
            else:
                self.keys[n] = np.unique(key)
                some, times = np.unique(key[trained[valid]], return_counts=True)
                self.counts[n] = np.zeros(len(self.keys[n]), np.int64)
                self.counts[n][np.searchsorted(self.keys[n], some)] = times
            h = (self.hashes[n - 1][self.keys[n] // size] ^ (hashes[self.keys[n] % size] * MIX[0])) * MIX[1]
            self.hashes[n] = (h ^ (h >> np.uint64(29))) & ~TAG | np.uint64(n)

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All n-grams by hash: hashes, counts, and the order that sorts them. A hash that two share stands twice."""
        every = np.concatenate(list(self.hashes.values()))
        order = np.argsort(every, kind="stable")
        return every[order], np.concatenate(list(self.counts.values()))[order], order

    def learn(self, totals: np.ndarray, n_tokens: int, n_words: int, mu: float) -> None:
        """Weights of arcs and failure arcs from the totals of the listed n-grams, in the order of ``listed``."""
        _, _, order = self.listed()
        flat = np.empty(len(totals), np.int64)
        flat[order] = totals
        borders = np.cumsum([len(h) for h in self.hashes.values()])[:-1]
        self.total = dict(zip(self.hashes, np.split(flat, borders), strict=True))
        p = {1: (self.total[1] + ADDED) / (n_tokens + ADDED * (n_words + 1))}
        self.arc, self.fail, self.shorter = {1: np.log10(p[1])}, {}, {1: np.zeros(self.size, np.int64)}
        for n in range(2, self.order + 1):
            prefix, last = self.keys[n] // self.size, self.keys[n] % self.size
            self.shorter[n] = last if n == 2 else np.searchsorted(self.keys[n - 1], self.shorter[n - 1][prefix] * self.size + last)
            p[n] = (self.total[n] + mu * p[n - 1][self.shorter[n]]) / (self.total[n - 1][prefix] + mu)
            self.arc[n] = np.log10(p[n])
        for n in range(1, self.order):
            self.fail[n] = np.log10(mu / (self.total[n] + mu))

    def walk(self) -> np.ndarray:
        """log10 probability of each document: segments of the texts walk the automaton side by side."""
        starts = np.flatnonzero((self.at - 1) % SEGMENT == 0)  # the first token a segment scores; the start mark is never scored
        starts = starts[self.at[starts] > 0]
        doc = np.repeat(np.arange(len(self.docs)), self.lengths)
        ends = np.minimum(starts + SEGMENT, np.cumsum(self.lengths)[doc[starts]])
        by = np.argsort(starts - ends, kind="stable")  # longest first
        starts, ends = starts[by], ends[by]
        level, state = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        score = np.zeros(len(starts))
        back = self.order - 1
        lengths = ends - starts
        for t in range(-back, int(lengths.max(initial=0))):  # the tokens before a segment only bring its lanes into their state
            n = len(starts) if t <= 0 else int(np.searchsorted(-lengths, -t, side="left"))
            lane = np.arange(n)
            lane = lane[self.at[starts[:n]] + t >= 0] if t < 0 else lane
            if not len(lane):
                continue
            word = self.ids[starts[lane] + t]
            weight = self.step(lane, word, level, state)
            if t >= 0:
                score[lane] += weight
        return np.bincount(doc[starts], score, minlength=len(self.docs))

    def step(self, lane: np.ndarray, word: np.ndarray, level: np.ndarray, state: np.ndarray) -> np.ndarray:
        """One word for each lane: failure arcs until an arc takes the word; states are brought up to date."""
        weight = np.zeros(len(lane))
        now, at = level[lane], state[lane]
        open_ = np.ones(len(lane), bool)
        for n in range(self.order - 1, -1, -1):
            here = np.flatnonzero(open_ & (now == n))
            if not len(here):
                continue
            if n == 0:
                took, gram = here, word[here]
            else:
                key = at[here] * self.size + word[here]
                where = np.minimum(np.searchsorted(self.keys[n + 1], key), len(self.keys[n + 1]) - 1)
                hit = (self.keys[n + 1][where] == key) & (self.total[n + 1][where] > 0)
                took, gram = here[hit], where[hit]
                miss = here[~hit]
                weight[miss] += self.fail[n][at[miss]]
                at[miss] = self.shorter[n][at[miss]]
                now[miss] = n - 1
            weight[took] += self.arc[n + 1][gram]
            open_[took] = False
            now[took], at[took] = n + 1, gram
        # A state is a context of at most order - 1 words that training has seen.
        for n in range(self.order, 0, -1):
            here = np.flatnonzero(now == n)
            down = here if n == self.order else here[self.total[n][at[here]] == 0]
            at[down] = self.shorter[n][at[down]]
            now[down] = n - 1
        level[lane], state[lane] = now, at
        return weight


def packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, of which only the bytes in use are kept."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    width = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    planes = steps[1:, None].view(np.uint8).reshape(-1, 8)[:, :width] if len(steps) > 1 else np.empty((0, width), np.uint8)
    return bytes([width]) + hashes[:1].tobytes() + planes.T.tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(blob[1:9], np.uint8)
    steps[1:, :blob[0]] = np.frombuffer(blob[9:], np.uint8).reshape(blob[0], n - 1).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8")[:, None].view(np.uint8).T.tobytes(), 1)


def unpacked_counts(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def log2_buckets(chars: int) -> int:
    return max(0, (max(1, chars) // BUCKET_CHARS).bit_length())


def bucket_borders(hashes: np.ndarray, bits: int) -> np.ndarray:
    marks = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.r_[0, np.searchsorted(hashes, marks), len(hashes)]


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict] | None]]:
    """(chunk, rows) of batches that come sorted by chunk; (chunk, None) closes one."""
    at = None
    for batch in batches:
        chunks = np.asarray(batch.column("chunk"))
        for part in np.split(np.arange(len(chunks)), np.flatnonzero(np.diff(chunks)) + 1):
            if len(part):
                if at is not None and chunks[part[0]] != at:
                    yield at, None
                at = int(chunks[part[0]])
                yield at, batch.slice(int(part[0]), len(part)).to_pylist()
    if at is not None:
        yield at, None


def score_documents(docs: DataFrame, order: int = ORDER, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Trained on the documents whose crc32(doc_id as text) mod 10 is not 0; all are scored. Tokens are the words between ASCII white
    space, A-Z lowered, then one end. base_score is the unigram's log10 probability, score the automaton's. A null or empty
    text is the end alone. Repeated rows count and are scored each by itself; rows without doc_id are dropped; other columns are
    ignored; an empty table gives an empty result.
    """
    texts = texts_of(docs)
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = log2_buckets(chars)
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chars // CHUNK_CHARS + 1)))

    def list_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(order)
        for number, rows in batched(batches):
            if rows is not None:
                for r in rows:
                    chunk.add(r["doc_id"], r["text"])
                continue
            chunk.close()
            hashes, counts, _ = chunk.listed()
            chunk = Chunk(order)
            borders = bucket_borders(hashes, bits)
            for b, (x, y) in enumerate(zip(borders, borders[1:])):
                yield pa.RecordBatch.from_pylist([{"bucket": b, "chunk": number, "n": int(y - x), "hashes": packed(hashes[x:y]), "counts": packed_counts(counts[x:y])}])

    listed = (dealt.repartition("chunk").sortWithinPartitions("chunk")
              .mapInArrow(list_grams, "bucket long, chunk long, n long, hashes binary, counts binary"))

    def add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([unpacked(h, n) for h, n in zip(rows["hashes"], rows["n"], strict=True)])
        counts = np.concatenate([unpacked_counts(c) for c in rows["counts"]])
        own, back = np.unique(hashes, return_inverse=True)
        total = np.bincount(back, counts, minlength=len(own)).astype(np.int64)
        words = own & TAG == 1
        answers = np.split(total[back], np.cumsum(rows["n"].to_numpy())[:-1])
        out = pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "bucket": key[0], "totals": [packed_counts(a) for a in answers], "tokens": 0, "words": 0})
        one = pd.DataFrame({"chunk": [-1], "bucket": [key[0]], "totals": [None], "tokens": [int(total[words].sum())], "words": [int((total[words] > 0).sum())]})
        return pd.concat([out, one])

    answers = stored(listed.groupBy("bucket").applyInPandas(add_up, "chunk long, bucket long, totals binary, tokens long, words long"))
    found = answers.where("chunk = -1").agg(F.sum("tokens"), F.sum("words")).first()
    n_tokens, n_words = found[0] or 0, found[1] or 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, totals = Chunk(order), []
        for _, rows in batched(batches):
            if rows is not None:
                for r in rows:
                    if r["kind"] == 0:
                        totals.append(unpacked_counts(r["totals"]))
                    else:
                        chunk.add(r["doc_id"], r["text"])
                continue
            chunk.close()
            chunk.learn(np.concatenate(totals), n_tokens, n_words, mu)
            doc, scored = np.repeat(np.arange(len(chunk.docs)), chunk.lengths), chunk.at > 0
            known = np.bincount(doc[scored], chunk.total[1][chunk.ids[scored]] > 0, minlength=len(chunk.docs))
            base = np.bincount(doc[scored], chunk.arc[1][chunk.ids[scored]], minlength=len(chunk.docs))
            yield pa.RecordBatch.from_arrays([pa.array(chunk.docs, pa.int64()), pa.array([held_out(d) for d in chunk.docs]), pa.array(chunk.lengths - 1), pa.array(known.astype(np.int64)),
                                              pa.array(np.full(len(chunk.docs), n_tokens, np.int64)), pa.array(base), pa.array(chunk.walk())],
                                             names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            chunk, totals = Chunk(order), []

    nothing = F.lit(None)
    told = answers.where("chunk >= 0").select("chunk", F.lit(0).alias("kind"), "bucket", "totals", nothing.cast("long").alias("doc_id"), nothing.cast("string").alias("text"))
    read = dealt.select("chunk", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("bucket"), nothing.cast("binary").alias("totals"), "doc_id", "text")
    return (told.union(read).repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
            .mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
