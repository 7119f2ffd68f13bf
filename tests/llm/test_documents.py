"""Near duplicates, sketches, licenses, language model, quality, personal data."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows
from textguard.llm import backoff_lm, bbit_minhash, license_rules, pii_tagger, scaled_sketch, weak_quality


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def component_by_brute_force(texts, n, percent):
    """doc_id -> (set size, smallest doc_id reachable)."""
    ids = sorted(texts)
    sets, root = {i: shingles(texts[i], n) for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(r, words, share):
    return [r.choice("abcdefgh") + str(r.randint(0, 9999)) if r.random() < share else w for w in words]


def near_copies():
    """Families whose members lie around the threshold, so that components chain and leaders miss links."""
    r, texts = random.Random(4), {}
    for family in range(6):
        base = [f"w{family}_{r.randint(0, 400)}" for _ in range(r.choice([12, 60, 150]))]
        members = [base]
        for _ in range(40):
            members.append(edited(r, r.choice(members), r.choice([0, 0.01, 0.02, 0.04, 0.08])))
        for m in members:
            texts[len(texts) * 3 + 5] = " ".join(m)
    return texts


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_lose_no_link(spark, n, percent):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "extra") for i, t in texts.items()], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in bbit_minhash.near_duplicates(docs, n, percent).collect()}
    assert got == component_by_brute_force(texts, n, percent)
    assert len({c for _, c in got.values()}) > 6


def test_near_duplicates_on_awkward_rows(awkward, nothing):
    got = rows(bbit_minhash.near_duplicates(awkward).select("doc_id", "n_shingles", "component_id", "kept"))
    by = {r[0]: r[1:] for r in got}
    assert len(got) == 9 and by[2] == by[3][:0] + (0, 2, True) and by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[5] == (1, 5, True)
    assert by[1] == (8, 1, True) and by[7][1] in (6, 7)
    assert bbit_minhash.near_duplicates(nothing).count() == 0
    assert sorted(r["doc_id"] for r in bbit_minhash.one_of_each(awkward).collect()).count(1) == 1


def test_estimate_corrects_for_chance(spark):
    r = np.random.default_rng(1)
    both = r.integers(0, 2**63, 700, np.uint64)
    a, b = (np.unique(np.r_[both, r.integers(0, 2**63, 150, np.uint64)] << np.uint64(1)) for _ in range(2))
    rows_ = [([int(x) for x in bbit_minhash.signature(bbit_minhash.minima(s))]) for s in (a, b, r.integers(0, 2**63, 500, np.uint64))]
    got = spark.createDataFrame([tuple(rows_)], "a array<long>, b array<long>, c array<long>").select(bbit_minhash.estimate(F.col("a"), F.col("b")), bbit_minhash.estimate(F.col("a"), F.col("c"))).first()
    assert abs(got[0] - 0.7) < 0.13 and abs(got[1]) < 0.1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 103), (103, 101), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in bbit_minhash.components(edges).collect())
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 103: 100}
    assert bbit_minhash.components(edges.limit(0)).count() == 0


def test_sketch_and_next_document(spark, awkward, some_documents, monkeypatch):
    monkeypatch.setattr(scaled_sketch, "BUCKET_ROWS", 16)  # many buckets: the borders between them count
    given = sorted((r["doc_id"], r["text"]) for r in some_documents.collect())
    got = {r["doc_id"]: r for r in scaled_sketch.fingerprint_edits(some_documents.repartition(5)).collect()}
    assert len(got) == len(given)
    errors = []
    for k, (doc, text) in enumerate(given):
        after = given[(k + 1) % len(given)][1]
        cut = len(text) // 4
        new, r = text[:len(text) - cut] + after[:cut], got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        a, b = shingles(text, 5), shingles(new, 5)
        if len(a | b) > 400:
            errors.append(r["near_edited"] - len(a & b) / len(a | b))
        assert r["near_next"] < 0.3 or len(a & shingles(after, 5)) > 0
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_sketch_is_exact_at_scale_one_and_mergeable(spark):
    texts = [("a b c d e f g h i j", "c d e f g h i j k l"), ("", "x"), ("same", "same"), (None, "")]
    df = spark.createDataFrame(texts, "a string, b string")
    s = {c: scaled_sketch.sketch(F.col(c), scale=1) for c in "ab"}
    got = df.select(scaled_sketch.likeness(s["a"], s["b"]), scaled_sketch.containment(s["a"], s["b"]), F.size(scaled_sketch.merged(s["a"], s["b"]))).collect()
    assert [tuple(r) for r in got] == [(4 / 8, 4 / 6, 8), (0.0, 0.0, 1), (1.0, 1.0, 1), (0.0, 0.0, 0)]


def test_sketch_on_awkward_rows(awkward, nothing, spark):
    got = scaled_sketch.fingerprint_edits(awkward).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2, 3, 4, 5, 6, 7, 9]
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (2, 3)}) == 1 and len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    assert scaled_sketch.fingerprint_edits(nothing).count() == 0
    assert scaled_sketch.fingerprint_edits(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()["near_next"] == 1.0


def test_base_phrases_by_brute_force(spark):
    r = random.Random(5)
    pool = "GNU General Public License, Apache License. cc by MIT License ü licen".split(" ")
    texts = [r.choice([" ", "\n", ""]).join(r.choice(pool) + r.choice(["", " ", ","]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    got = {x["doc_id"]: x for x in license_rules.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for doc, text in enumerate(texts):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(k, label) for phrase, label in license_rules.BASE.items() for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
        r = got[doc]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        for d in r["detections"]:
            assert 0 <= d["start"] < d["end"] <= len(text)


@pytest.mark.parametrize("text,labels", [
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", {"mit"}), ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}), ("under the Mozilla Public License 2.0", {"mpl"}),
    ("GNU Lesser General Public License v2.1", {"lgpl"}), ("Licensed under CC BY-NC 4.0. All rights reserved.", {"cc-by-nc", "all-rights-reserved"}), ("no licence at all, mit der Zeit", set()),
    ("Released under the MIT License.\nCopyright (c) 2021 x", {"mit", "copyright"}), ("the   two-clause\nBSD License", {"bsd-2-clause"})])
def test_signature_rules(text, labels):
    assert {x[2] for x in license_rules.detect(text.encode().lower().decode())} == labels


def test_suppression_by_brute_force():
    r, rules = random.Random(2), license_rules.rules()
    for _ in range(200):
        found = sorted(((a, a + r.randint(1, 12), r.choice(rules)) for a in (r.randint(0, 30) for _ in range(r.randint(0, 15)))), key=lambda d: (d[0], -d[1], -d[2].priority))
        want = [d for d in found if not any(o is not d and o[0] <= d[0] and d[1] <= o[1] and (o[2].priority, o[1] - o[0]) > (d[2].priority, d[1] - d[0]) for o in found)]
        assert license_rules.settle(found) == want
    assert len(rules) > 300


def test_licenses_on_awkward_rows(awkward, nothing):
    got = {r["doc_id"]: r for r in license_rules.scan(awkward).collect()}
    assert got[2]["n_words"] == got[3]["n_words"] == 0 and got[2]["labels"] == "" and got[2]["score"] == 0 and license_rules.digest(nothing).count() == 0


def model_by_brute_force(texts, order, mu):
    tokens = {i: ["<s>", *words_of(t), "<e>"] for i, t in texts}
    c = Counter(tuple(t[k:k + n]) for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for n in range(1, order + 1) for k in range(len(t) - n + 1))
    uni = {g[0]: n for g, n in c.items() if len(g) == 1 and g[0] != "<s>"}
    total, kinds = sum(uni.values()), len(uni)

    def p(context, w):
        return (c[(*context, w)] + mu * p(context[1:], w)) / (c[context] + mu) if context else (uni.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1))

    return {i: (len(t) - 1, sum(w in uni for w in t[1:]), total, sum(math.log10(p((), w)) for w in t[1:]),
                sum(math.log10(p(tuple(t[max(0, k - order + 1):k]), t[k])) for k in range(1, len(t)))) for i, t in tokens.items()}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_by_brute_force(spark, awkward, order, monkeypatch):
    monkeypatch.setattr(backoff_lm, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(backoff_lm, "BUCKET_CHARS", 1500)
    monkeypatch.setattr(backoff_lm, "SEGMENT", 7)
    r = random.Random(6)
    texts = [(i, " ".join(r.choice(["the", "a", "cat", "Dog", "x%d" % r.randint(0, 30)]) for _ in range(r.randint(0, 60)))) for i in range(200)]
    got = {x["doc_id"]: x for x in backoff_lm.score_documents(spark.createDataFrame(texts, "doc_id long, text string"), order, 5.0).collect()}
    for i, want in model_by_brute_force(texts, order, 5.0).items():
        x = got[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == want[:3] and x["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(x["base_score"], want[3], rel_tol=1e-12) and math.isclose(x["score"], want[4], rel_tol=1e-12)


def test_language_model_on_awkward_rows(spark, awkward, nothing):
    got = {r["doc_id"]: r for r in backoff_lm.score_documents(awkward).collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == got[4]["n_tokens"] == 1 and len(got) == 8
    assert backoff_lm.score_documents(nothing).count() == 0
    alone = backoff_lm.score_documents(spark.createDataFrame([(0, "a b"), (12, "")], "doc_id long, text string")).collect()
    assert all(math.isfinite(r["score"]) for r in alone)


def test_hashes_pack_and_unpack():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        h = np.sort(r.integers(0, 2**64, n, np.uint64))
        assert np.array_equal(backoff_lm.unpacked(backoff_lm.packed(h) if n else b"", n), h)
        c = r.integers(0, 2**40, n)
        assert np.array_equal(backoff_lm.unpacked_counts(backoff_lm.packed_counts(c)), c)


def test_quality_against_gold_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gold = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = weak_quality.classify(docs).join(gold, "doc_id").collect()
    assert sum(r["keep"] == (r["quality"] == 1) for r in got) / len(got) > 0.97
    assert all(r["keep"] for r in got if r["quality"] == 1 and r["toxic"] == 1)


def test_label_model_finds_each_labellers_chances():
    r = np.random.default_rng(1)
    counts, truth = Counter(), Counter()
    for _ in range(20000):
        kind = r.integers(0, 4) if r.random() < 0.15 else None  # junk of one kind, which mostly one labeller sees
        code = sum((2 if (kind == k and r.random() < 0.9) or r.random() < 0.001 else 1) * 3**k for k in range(10))
        counts[code] += 1
        truth[code] += kind is not None
    found = weak_quality.label_model(counts)
    assert sum(counts[c] for c in counts if (found[c] > 0.5) == (truth[c] > counts[c] / 2)) > 0.97 * 20000
    assert weak_quality.label_model({}) == {}


def test_quality_on_awkward_rows(awkward, nothing):
    got = weak_quality.classify(awkward).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2, 3, 4, 5, 6, 7, 9] and {r["votes"] for r in got if r["doc_id"] in (2, 3, 4)} == {"-" * 10}
    assert weak_quality.classify(nothing).count() == 0 and weak_quality.accepted(nothing).count() == 0
    kept = weak_quality.accepted(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["keep"])


def plain_spans(text):
    """The contract's patterns, read once more."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", text):
        if max(map(int, m[0].split("."))) <= 255:
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(d[::2]) % 10 == -sum(2 * x - 9 * (x > 4) for x in d[1::2]) % 10:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_by_brute_force(spark):
    r = random.Random(7)
    texts = [pii_tagger.labelled(r, 200)[0] for _ in range(150)] + ["1.2.3.4.5 999.1.1.1 0001.2.3.4", "+1 (2", "4111 1111 1111 1111-", "a@b.c@d.e", "é 4111111111111111"]
    got = {x["doc_id"]: x for x in pii_tagger.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for doc, text in enumerate(texts):
        want, x = plain_spans(text), got[doc]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert x["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [x[f"n_{k}"] for k in pii_tagger.KINDS] == [sum(s[0] == k for s in want) for k in pii_tagger.KINDS]
        assert set(joined.split(",")) - {""} <= set(x["spans"].split(","))


def test_tagger_on_held_out_texts():
    r, model = random.Random(99), pii_tagger.trained()
    made = [pii_tagger.labelled(r, 300) for _ in range(300)]
    found = pii_tagger.tagged([t for t, _ in made], model)
    hits = sum(len(set(g) & set(f)) for (_, g), f in zip(made, found, strict=True))
    assert hits / sum(len(g) for _, g in made) > 0.9 and hits / sum(map(len, found)) > 0.9


def test_windows_agree_with_one_long_window(monkeypatch):
    r, model = random.Random(3), pii_tagger.trained()
    text = " ".join(pii_tagger.labelled(r, 150)[0].replace("\0", " ") for _ in range(20))
    short = pii_tagger.tagged([text], model)
    monkeypatch.setattr(pii_tagger, "WINDOW", 4096)
    long = pii_tagger.tagged([text], model)
    assert len(set(short[0]) & set(long[0])) >= 0.95 * len(long[0])


def test_windows_far_from_signs_have_no_say():
    r, model, texts = random.Random(8), pii_tagger.trained(), []
    for _ in range(60):
        words = [pii_tagger.syllables(r) for _ in range(r.randint(0, 400))]
        for _ in range(r.randint(0, 3)):
            words.insert(r.randint(0, len(words)), r.choice([pii_tagger.personal(r)[0], pii_tagger.harmless(r), "at", "look at that dot", "at x.y"]))
        texts.append(" ".join(words))
    assert pii_tagger.tagged(texts, model) == pii_tagger.tagged(texts, model, every=True)
    assert sum(len(pii_tagger.window_starts(t, False)) for t in texts) < sum(len(pii_tagger.window_starts(t, True)) for t in texts)


def test_skipped_windows_hold_no_span():
    r, model = random.Random(4), pii_tagger.trained()
    x = np.array([pii_tagger.classes(pii_tagger.labelled(r, 120)[0]) for _ in range(200)]).T.copy()
    e = pii_tagger.emissions(model, x)
    hopeful, best = pii_tagger.hopeful(e, model["trans"]), pii_tagger.viterbi(e, model["trans"])
    assert not best[:, ~hopeful].any() and best[:, hopeful].any()


def test_gradients_by_differences(monkeypatch):
    monkeypatch.setattr(pii_tagger, "LEAK", 0.0)
    r, rng = random.Random(1), np.random.default_rng(0)
    x, gold = pii_tagger.batch_of([pii_tagger.labelled(r, 30) for _ in range(8)])
    n, k = pii_tagger.HIDDEN, 5
    model = {"b": np.zeros(k), "trans": np.zeros((k, k))}
    for d in "01":
        model |= {f"wx{d}": rng.normal(0, 0.1, (pii_tagger.CLASSES, 4 * n)) + np.r_[np.full(3 * n, 0.5), np.zeros(n)], f"wh{d}": rng.normal(0, 0.1, (n, 4 * n)), f"we{d}": rng.normal(0, 0.3, (n, k))}
    model = {a: w.astype(np.float32) for a, w in model.items()}
    _, grads = pii_tagger.loss_gradient(model, x, gold)
    for name, g in grads.items():
        d = rng.normal(size=g.shape).astype(np.float32)
        up, down = (pii_tagger.loss_gradient(model | {name: model[name] + s * d / np.linalg.norm(d)}, x, gold)[0] for s in (0.01, -0.01))
        assert math.isclose((up - down) / 0.02, float((g * d).sum() / np.linalg.norm(d)), rel_tol=0.05, abs_tol=0.01)


def test_personal_data_on_awkward_rows(awkward, nothing):
    got = pii_tagger.digest(awkward).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2, 3, 4, 5, 6, 7, 9] and {r["spans"] for r in got if r["doc_id"] in (2, 3, 4, 5)} == {""}
    assert pii_tagger.digest(nothing).count() == 0
    made = pii_tagger.redact(awkward)
    assert made.columns == awkward.columns and {r["text"] for r in made.collect() if r["doc_id"] == 2} == {None}


def test_redaction():
    assert pii_tagger.redacted("x a@b.c y 1.2.3.4", [("email", 2, 7), ("ip", 10, 17)]) == "x [EMAIL] y [IP]"
    assert pii_tagger.redacted("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a[CARD]f"
