"""Byte-pair encoding and decoding, merges run in numpy over many words at once.

All words that a batch shows for the first time lie in one flat array of symbols. A round finds each adjacent pair's rank by binary
search over the sorted pair keys, takes the lowest rank of each word and merges that pair wherever it stands in the word. A word
leaves the array when no pair of it merges any more. Each distinct word is merged once for each worker.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import CACHE_ENTRIES, PIECE, SPACE, only_cache, texts_of

#: Words within a piece of text, as the byte-level tokenizer cuts them.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = np.iinfo(np.int64).max


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in the vocabulary file: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Merger:
    """The vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, signs = spec["model"]["vocab"], spec["model"]["merges"], byte_signs()
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.byte = np.zeros(256, np.int64)
        self.bytes_of = [b""] * self.size
        for sign, b in signs.items():
            self.byte[b] = vocab[sign]
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(signs[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.word = regex.compile(WORD)
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each (non-empty) word."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        sym, at = self.byte[np.frombuffer(b"".join(raw), np.uint8)], np.repeat(np.arange(len(raw)), lengths)
        done_sym, done_at = [], []
        while len(sym):
            first = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
            pair = np.empty(len(sym), np.int64)
            pair[:-1] = sym[:-1] * self.size + sym[1:]
            pair[np.r_[first[1:] - 1, len(sym) - 1]] = -1
            where = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(self.keys[where] == pair, self.ranks[where], NONE)
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            over = low == NONE
            hits = np.flatnonzero((rank == low) & ~over)
            if len(hits):  # of overlapping hits every second one, from the left
                start = np.r_[True, np.diff(hits) > 1]
                since = hits - hits[np.maximum.accumulate(np.where(start, np.arange(len(hits)), 0))]
                hits = hits[since % 2 == 0]
                sym[hits] = self.made[where[hits]]
            if over.any():
                done_sym.append(sym[over])
                done_at.append(at[over])
            keep = ~over
            keep[hits + 1] = False
            sym, at = sym[keep], at[keep]
        flat, owner = np.concatenate(done_sym), np.concatenate(done_at)
        order = np.argsort(owner, kind="stable")
        return np.split(flat[order], np.cumsum(np.bincount(owner, minlength=len(raw)))[:-1])

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > CACHE_ENTRIES // 2:
            self.pieces.clear()
            self.words.clear()
            new = list(pieces)
        cut = [self.word.findall(p) for p in new]
        fresh = list({w for c in cut for w in c if w not in self.words})
        for k in range(0, len(fresh), 8192):
            for w, ids in zip(fresh[k:k + 8192], self.merge(fresh[k:k + 8192]), strict=True):
                self.words[w] = ids.astype("<u4").tobytes()
        for p, c in zip(new, cut, strict=True):
            self.pieces[p] = b"".join([self.words[w] for w in c])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        split = [self.around.split(t) if self.around and any(s in t for s in self.special) else [t] for t in texts]
        cut = [[s if s in self.special else PIECE.findall(s) for s in parts] for parts in split]
        self.learn({p for parts in cut for s in parts if not isinstance(s, str) for p in s})
        get, special = self.pieces.__getitem__, {s: np.uint32(i).tobytes() for s, i in self.special.items()}
        return [b"".join([special[s] if isinstance(s, str) else b"".join(map(get, s)) for s in parts]) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary are passed over."""
        get, size = self.bytes_of.__getitem__, self.size
        if len(ids) and not (0 <= ids.min() and ids.max() < size):
            ids = ids[(ids >= 0) & (ids < size)]
        return b"".join(map(get, ids.tolist())).decode("utf-8", "replace")


def merger(path: str) -> Merger:
    held = only_cache("mergers")
    if path not in held:
        held[path] = Merger(path)
    return held[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text, no special tokens added.

    Null or empty text: an empty array. Repeated rows give repeated rows; a row without doc_id is dropped; other columns are ignored.
    ``path`` is a byte-level BPE file that executors can read. Map-only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                made = merger(path).encode(part.column(1).to_pylist())
                ends = np.r_[0, np.cumsum([len(b) // 4 for b in made])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: the text that ``ids array<int>`` stand for. Null ids: empty text; null elements are passed over. Map-only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                col = part.column(1)
                flat, lengths = col.flatten(), np.asarray(pa.compute.list_value_length(col).fill_null(0))
                ids = np.asarray(flat.fill_null(-1) if flat.null_count else flat, np.int64)
                texts = [merger(path).decode(x) for x in np.split(ids, np.cumsum(lengths)[:-1])] if part.num_rows else []
                yield pa.RecordBatch.from_arrays([part.column(0), col, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of every text encoded and decoded again."""
    back = decode(encode(docs, path), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
