"""The cost of op3_context_coder: work per id and per word, and what must stay right while it is small."""
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textguard.llm import common, context_coder

WORDS = public_tokenizers.path("word_bpe_49k.json")


def zipf(n, kinds, seed=3):
    share = 1 / np.arange(1, kinds + 1)
    return np.random.default_rng(seed).choice(kinds, n, p=share / share.sum()).astype(np.uint32)


def test_coding_takes_little_time_for_an_id():
    ids = zipf(1_000_000, 3000)
    took = []
    for _ in range(2):
        began = time.process_time()
        assert np.array_equal(context_coder.decode_segment(context_coder.encode_segment([1], [len(ids)], ids))[2], ids)
        took.append(time.process_time() - began)
    assert min(took) < 1.8  # 3.4 s when each id was three symbols of three mixed rows


def test_rare_ids_are_predicted_too():
    ids = zipf(1_000_000, 40_000)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    segment = context_coder.encode_segment([1], [len(ids)], ids)
    assert len(segment) * 8 / len(ids) < 1.15 * entropy  # 15.3 bits when rare ids stood beside the code, 10.7 being the entropy
    assert np.array_equal(context_coder.decode_segment(segment)[2], ids)


@pytest.mark.parametrize("ids", [[7], [7] * 5000, [2**32 - 1, 0] * 700, list(range(3000)), [5] * 1499 + [6] * 3])
def test_few_and_odd_ids_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert np.array_equal(context_coder.decode_segment(context_coder.encode_segment([1], [len(ids)], ids))[2], ids)


def test_broken_words_are_reported():
    segment = context_coder.encode_segment([1], [30_000], zipf(30_000, 500))
    for at in range(len(segment) - 9000, len(segment), 701):
        broken = bytearray(segment)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            context_coder.decode_segment(bytes(broken))


def test_each_head_goes_to_the_library_once(monkeypatch):
    asked, plain = [], common.Words.encode
    monkeypatch.setattr(common.Words, "encode", lambda self, heads: asked.extend(heads) or plain(self, heads))
    common.only_cache("another")
    texts = ["Qualomere, qualomere. QUALOMERE vintasso", "vintasso! Vintasso;", "qualomere"] * 50
    got = common.word_ids(texts, WORDS)
    assert sorted(asked) == ["qualomere", "vintasso"]
    library = Tokenizer.from_file(WORDS)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", [
    "", " ", " \t\n", "É", "ÉCOLE, école", "Straße ẞ", "İstanbul ıI", "ΣΑΣ. ς", "á. Á", "ﬁn, ª º µ µ.", "x\xa0y\x85z", "x\x1cy", "a-. -.. ... .a", "1234. 12,", "don't. I'LL, we've's",
    "<|STARTOFTEXT|> a", "a<|endoftext|>b", "<|EndOfText|>", "日本語。 한국어, ไทย", "👍🏽! a👍.", "a\0b, \0 .", "naïve​. x y", "Ⅷ. ²³.", "ÀÖØÞß÷×ÿ.", "a'S. 'S 's", "﻿a.", "ǅ. Ǆ", "𝒜bc."])
def test_words_are_as_the_library_has_them(text):
    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    assert [np.frombuffer(b, "<u4").tolist() for b in common.word_ids([text, text + " end."], WORDS)] == [library.encode(t, add_special_tokens=False).ids for t in (text, text + " end.")]
