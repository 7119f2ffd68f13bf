"""Centroid clustering, source divergence and secret scans, against plain versions."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from textguard.llm import centroid_matrix as M
from textguard.llm import count_bitmaps as B
from textguard.llm import entropy_secrets as S

DATA = "/root/testdata/sf0.001"
FROM = {"op11_centroid_matrix": "embeddings", "op12_count_bitmaps": "documents"}


@pytest.mark.parametrize("name", FROM)
def test_queries_match_their_twins(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {FROM[name]} AS SELECT * FROM '{DATA}/{FROM[name]}.parquet'")
    df = entry.queries()[name](spark, DATA)
    res = con.execute(entry.oracle_sql()[name])
    assert [d[0] for d in res.description] == df.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(res.fetchall())


# ------------------------------------------------------------------ clusters
def lloyd(rows, k, rounds, dims, scale):
    """(vec_id, cluster, distance) and the centroids, every distance worked out anew with Python's integers."""
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    places = [list(x) for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(places))

    for _ in range(rounds):
        of = defaultdict(list)
        for _, x in kept:
            of[nearest(x)[1]].append(x)
        for n, members in of.items():
            places[n] = [sum(column) // len(members) for column in zip(*members)]
    return [(i, *reversed(nearest(x))) for i, x in kept], places


@pytest.mark.parametrize("block", [7, 4096])
def test_clusters_by_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = [(i, [rng.choice([-1, 0, 1]) * rng.random() * 3 for _ in range(4)]) for i in range(120)]
    rows += [(7, rows[7][1]), (500, rows[8][1]), (None, [0.5] * 4), (501, None), (502, [1.0]), (503, [1.0, None, 0.0, 0.0]), (504, [float("nan")] * 4), (505, [float("inf")] * 4), (506, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 3, 4) for i, v in rows], "vec_id long, embedding array<double>, points string, cluster int, ids int").repartition(3)
    got = M.cluster(df, k=6, rounds=3, dims=4, scale=16).collect()
    want, places = lloyd(rows, 6, 3, 4, 16)
    def key(r):
        return (r[0] is None, *r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, places[r.cluster])).encode()).hexdigest()


def test_fewer_vectors_than_centroids_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = M.cluster(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [1.0, 2.0])], schema), k=40, dims=2)
    assert sorted((r.vec_id, r.distance) for r in few.collect()) == [(1, 0), (2, 0), (3, 0)] and len({r.cluster for r in few.collect()}) == 2
    for rows in ([], [(None, [1.0, 2.0])], [(1, None)]):
        none = M.cluster(spark.createDataFrame(rows, schema), dims=2)
        assert none.collect() == [] and none.columns == few.columns


def test_kept_products_are_those_worked_out_anew():
    rng = np.random.default_rng(5)
    for top in (300, M.LARGEST):  # doubles are exact for the first, integers are needed for the second
        points, a, b = (rng.integers(-top, top, (n, 64)) for n in (50, 9, 9))
        b[:, 10:] = a[:, 10:]  # few components change
        b[3] = a[3]
        dots = M.added(M.added(np.zeros((50, 9), np.int64), points, a), points, b - a)
        assert (dots == points @ b.T).all()


def test_too_large_components_end_with_a_message():
    with pytest.raises(ValueError, match="64 bits"):
        M.whole(np.array([[1e30]]), 256)


# ------------------------------------------------------------------ divergence
def divergence(rows, least, ranks):
    found = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {f[0] for f in found}:
        mine = [f for f in found if f[0] == lang]
        docs = Counter(t for _, _, w in mine for t in set(w))
        kept = {t for t, n in docs.items() if n >= least}
        counts = {s: Counter(t for _, x, w in mine if x == s for t in w if t in kept) for s in {f[1] for f in mine}}

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        whole, p = shares(sum(counts.values(), Counter())), {s: shares(c) for s, c in counts.items()}
        for s in counts:
            far = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            typical = [(t, p[s][t] - whole[t]) for t in kept if counts[s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", far, len(far)), ("term", typical, ranks)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, k))
    return sorted(out)


@pytest.mark.parametrize("chunk, side, entries", [(2048, 32, 400_000), (3, 2, 5)])
def test_divergence_by_brute_force(spark, chunk, side, entries, monkeypatch):
    monkeypatch.setattr(B, "TILE", side)
    monkeypatch.setattr(B, "COUNTED_AT_ONCE", entries)
    monkeypatch.setattr(B, "WORDS_AT_ONCE", 4 if chunk == 3 else 1 << 20)
    rng = random.Random(chunk)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60)] + ["Été", "ça", "中文", "X\x00y", "it's", "\U0001f600"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", "e", None]), " ".join(rng.choice(words[: rng.choice([5, 20, 66])]) for _ in range(rng.choice([0, 3, 40])))) for _ in range(90)]
    rows += [rows[0], rows[0], ("de", "a", "eins"), ("de", "b", None), ("de", "c", "12 !"), ("it", "only", ""), ("en", "empty", "7"), (None, None, None)]
    df = spark.createDataFrame([(i, t, la, s, 5, 1, 0, 0) for i, (la, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, rank int, band int, p int").repartition(4)
    counts = B.Counts
    monkeypatch.setattr(B, "Counts", lambda docs, least: counts(docs, least, chunk))
    assert sorted(tuple(r) for r in B.audit(df, least=4, ranks=6).collect()) == divergence(rows, 4, 6)


def test_divergence_of_nothing_and_of_awkward_rows(spark, awkward):
    df = awkward.selectExpr("doc_id", "text", "rank AS lang", "'s' AS source", "score")
    assert B.audit(df.limit(0)).collect() == []
    rows = [(r.lang, r.source, r.text) for r in df.collect()]
    assert sorted(tuple(r) for r in B.audit(df, least=2).collect()) == divergence(rows, 2, 50)


def test_levels_of_a_group_are_disjoint_and_whole():
    n, p, ids = np.array([3, 1, 3, 2]), np.array([30, 10, 30, 20]), np.array([0, 64, 99, 7])
    counts, shares, bits = B.bitset(n, p, ids, 100)
    flags = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(3, -1), axis=1, bitorder="little")
    assert (counts, shares) == ([1, 2, 3], [10, 20, 30]) and flags.shape[1] == 128
    assert [np.flatnonzero(f).tolist() for f in flags] == [[64], [7], [0, 99]]


# ------------------------------------------------------------------ secrets
def plain_base(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def plain_entropy(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def plain_random(text, base):
    """Each class's candidates by characters, each window's entropy from scratch."""
    inside = [False] * len(text)
    for _, a, b in base:
        inside[a:b] = [True] * (b - a)
    taken, out = [False] * len(text), []
    members = {"entropy_hex": ["0123456789abcdef", "0123456789ABCDEF"], "entropy_upper": ["0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"], "entropy_lower": ["0123456789abcdefghijklmnopqrstuvwxyz"],
               "entropy_base64": ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]}
    alnum = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    for kind in S.CLASSES:
        for chars in members[kind.kind]:
            a = 0
            while a < len(text):
                b = a
                while b < len(text) and text[b] in chars:
                    b += 1
                alone = kind.kind == "entropy_base64" or not (a and text[a - 1] in alnum) and not (b < len(text) and text[b] in alnum)
                if b - a >= 20 and alone and all(n.search(text[a:b]) for n in kind.needs):
                    marked = [False] * (b - a)
                    for k in range(b - a - 19):
                        if plain_entropy(text[a + k:a + k + 20]) >= kind.entropy:
                            marked[k:k + 20] = [True] * 20
                    k = 0
                    while k < len(marked):
                        e = k
                        while e < len(marked) and marked[e]:
                            e += 1
                        x, y = a + k, a + e
                        if e > k and not any(taken[x:y]) and not all(inside[x:y]) and all(n.search(text[x:y]) for n in kind.needs) and not S.allowed(text, x, y):
                            out.append((kind.kind, x, y))
                            taken[x:y] = [True] * (y - x)
                        k = max(e, k + 1)
                a = max(b, a + 1)
    return out


def drawn(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]


def test_spans_by_brute_force():
    rng = random.Random(11)
    between = [" ", "\n", "'", '"', ": ", "=", "-", "_", ".", "é", "password=", "token = \"", "API_KEY: ", "api-key=", "Secret'='", "toKen:", "ſecret=", "AKIA", "AKIAAB", "the word ", "sha256:", "x"]
    some = 0
    for _ in range(400):
        text = "".join(rng.choice(between) + (drawn(rng, rng.choice(ALPHABETS), rng.choice([5, 8, 19, 20, 24, 32, 40, 70])) if rng.random() < 0.6 else "") for _ in range(rng.randint(1, 9)))
        base = S.base_spans(text)
        assert base == plain_base(text), text
        found = S.random_spans(text, base)
        # The hexadecimal class has two alphabets; a plain walk takes them one after the other.
        assert sorted(found) == sorted(plain_random(text, base)), text
        some += len(found)
    assert some > 300


def test_entropy_by_counts_is_that_of_each_window():
    rng = random.Random(2)
    for n in (1, 19, 20, 21, 300):
        run = drawn(rng, "abcd0123" if n % 2 else "ab", n)
        got = list(S.entropies(run))
        assert len(got) == max(0, n - 19) and all(abs(g - plain_entropy(run[k:k + 20])) < 1e-8 for k, g in enumerate(got))


def test_random_strings_are_found_and_words_are_not():
    rng = random.Random(4)
    for alphabet, share in zip(ALPHABETS, (0.95, 0.95, 0.95, 0.95, 0.95)):
        hits = sum(bool(S.random_spans(f"key {s} end", [])) for s in (drawn(rng, alphabet, 40) for _ in range(300)))
        assert hits >= share * 300, alphabet
    for clean in ("ineauéaienéeeurieuxeuéleur and unenthonerthinghingtion", "3f2b8c1e-9d4a-4e77-8b21-0c9f6a5d4e3b", "sha256:9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08",
                  "getUserProfileByAccountIdentifierV2", "0123456789abcdefghij0123", "EXAMPLEKEY123456789012", "aaaaaaaaaaaaaaaaaaaaaaaa1B", "12345678901234567890123456", "https-www-Example-2024-path-to-Some-page"):
        assert S.random_spans(clean, []) == [], clean


def test_secrets_on_awkward_rows(spark, awkward):
    got = S.digest(awkward).collect()
    assert len(got) == awkward.where("doc_id is not null").count() and {r.n_hex for r in got} == {0}
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()} and S.digest(awkward.limit(0)).collect() == []
    key = "wJalrXUtnFEMI7K9bPxRfiCYz0LkQm3T"
    text = "é password=hunter2hunter2 " + "long " * 50_000 + key
    one = S.digest(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, base string")).first()
    assert one.spans == f"assign:2:25,entropy_base64:{len(text) - len(key)}:{len(text)}"
    assert one.base_sha256 == hashlib.sha256(b"assign:2:25").hexdigest() and (one.n_assign, one.n_access, one.n_hex) == (1, 0, 0)


def test_very_long_runs_end():
    rng = random.Random(8)
    text = "-".join(drawn(rng, ALPHABETS[0], 24) for _ in range(4000))
    assert len(S.random_spans(text, S.base_spans(text))) > 3000
