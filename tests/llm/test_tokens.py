"""BPE, the coder's files, packing."""
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textguard.llm import bpe, common, context_coder, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SIGNS = " \t\n\r\x0b\x0c\x1c\x85\xa0 　\0aaabB'stre123²½é́ß.!?-\U0001F600ſİkΣσ﻿"


def odd_texts(n=3000):
    r = random.Random(3)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["a<|endoftext|>b  <|endoftext|> x", "'s 't I'LL don't", "a" * 3000, "<|startoftext|>"]


@pytest.mark.parametrize("path,ids_of", [(BYTES, common.byte_ids), (WORDS, common.word_ids)])
def test_ids_by_pieces_are_the_librarys(path, ids_of):
    texts = odd_texts()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in ids_of(texts, path)] == want


def test_merge_rounds_give_the_librarys_ids_and_texts():
    texts, library, own = odd_texts(), Tokenizer.from_file(BYTES), bpe.Merger(BYTES)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<u4")
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_decode_of_broken_bytes_and_foreign_ids():
    own, library = bpe.Merger(BYTES), Tokenizer.from_file(BYTES)
    for ids in ([171, 172, 64], [50256, 223], list(range(150, 260))):
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([64, 99999, -1, 65])) == own.decode(np.array([64, 65]))


def test_bpe_on_awkward_rows(spark, awkward, nothing):
    got = bpe.decode(bpe.encode(awkward, BYTES), BYTES).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2, 3, 4, 5, 6, 7, 9]
    want = {r["doc_id"]: r["text"] or "" for r in awkward.collect() if r["doc_id"] is not None}
    assert all(r["text"] == want[r["doc_id"]] for r in got)
    assert bpe.round_trip_digests(nothing, BYTES).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [64, None])], "doc_id long, ids array<int>"), BYTES).orderBy("doc_id").collect()[1]["text"] == "a"


@pytest.mark.parametrize("n", [0, 1, 511, 513, 5000, 70000])
def test_segments_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.01, rng.integers(0, 2**32, n), rng.zipf(1.3, n) % 9000).astype(np.uint32)
    counts = [n // 3, 0, n - n // 3]
    docs, found, out = context_coder.decode_segment(context_coder.encode_segment([7, 8, 9], counts, ids))
    assert docs.tolist() == [7, 8, 9] and found.tolist() == counts and np.array_equal(out, ids)


def test_blocks_stand_alone_and_are_checked():
    ids = np.random.default_rng(1).integers(0, 300, 6000).astype(np.uint32)
    segment = context_coder.encode_segment([1], [6000], ids)
    size = int(context_coder.blocks_of(6000)[0])
    assert np.array_equal(context_coder.decode_segment(segment, [3])[2], ids[3 * size:4 * size])
    for at in (20, 60, len(segment) - 400):
        broken = bytearray(segment)
        broken[at] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            context_coder.decode_segment(bytes(broken))


def test_context_mixing_saves_space(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    ids = np.frombuffer(b"".join(common.word_ids(texts, WORDS)), "<u4")
    assert len(context_coder.encode_segment([1], [len(ids)], ids)) < 0.95 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    # Where an id tells much of the next one, the higher orders go below what the ids' frequencies allow.
    r = np.random.default_rng(2)
    follow, chain = r.integers(0, 30, (30, 2)), np.zeros(200_000, np.uint32)
    for k in range(1, len(chain)):
        chain[k] = follow[chain[k - 1], r.integers(0, 2)]
    share = np.bincount(chain) / len(chain)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert len(context_coder.encode_segment([1], [len(chain)], chain)) * 8 / len(chain) < 0.85 * entropy


def test_files_hold_every_document_in_order(spark, awkward, nothing, some_documents):
    t = Tokenizer.from_file(WORDS)
    for docs in (awkward, some_documents, nothing):
        folder = common.shared_folder(spark)
        context_coder.write_ids(docs, WORDS, 2, folder)
        got = context_coder.read_documents(spark, folder).orderBy("start").collect()
        given = sorted((r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] is not None)
        assert [r["doc_id"] for r in got] == [d for d, _ in given]
        at = 0
        for r in got:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["n_tokens"]
        assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((d, t.encode(x, add_special_tokens=False).ids + [2]) for d, x in given)


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
            go(i + 1, [*bins[:k], bins[k] - items[i], *bins[k + 1:]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    r = random.Random(1)
    for _ in range(250):
        capacity = r.choice([10, 17, 30])
        items = [r.randint(1, capacity) for _ in range(r.randint(0, 9))]
        fixed, left = packing.reduce_instance(Counter(items), capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(items, capacity)
        plan, held = packing.packing_plan(Counter(items), capacity), Counter()
        for pattern, n in plan:
            assert sum(s * k for s, k in pattern) <= capacity
            for s, k in pattern:
                held[s] += k * n
        assert held == Counter(items) and sum(n for _, n in plan) <= fewest(items, capacity) + 1
    with pytest.raises(ValueError):
        packing.packing_plan({11: 1}, 10)


def test_packing_has_no_gaps_and_loses_nothing(spark, awkward, nothing, some_documents, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_TO_NUMBER", 50)
    t = Tokenizer.from_file(BYTES)
    for docs, capacity in ((awkward, 64), (some_documents, 256), (nothing, 64)):
        got = packing.pack_documents(docs, BYTES, 0, capacity).collect()
        by = {}
        for r in got:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect() if r["doc_id"] is not None}
        assert {r["doc_id"] for r in got} == set(ids)
        for r in got:
            n = len(ids[r["doc_id"]])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4").tobytes())
            assert r["length"] == (n % capacity or capacity if r["piece"] == 0 else capacity)
        if got:
            assert len(by) <= 1.02 * -(-sum(r["length"] for r in got) // capacity) + 1


def test_hot_length_is_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_TO_NUMBER", 100)
    pieces = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(5).cast("long").alias("length"))
    got = packing.pack(pieces, 20).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 2000 and len({r["sequence_id"] for r in got}) == 500
