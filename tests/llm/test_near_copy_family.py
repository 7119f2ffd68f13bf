"""Families of near copies that the leaders do not join: whole results, and pairs in proportion to the family."""
from __future__ import annotations

import random

import pytest

from textguard.llm import bbit_minhash


def family(n: int, words: int = 60, edited: float = 0.03, vocabulary: int = 4000) -> list[tuple[int, str]]:
    r = random.Random(8)
    base = [f"w{r.randrange(vocabulary)}" for _ in range(words)]
    return [(k, " ".join(f"w{r.randrange(vocabulary)}" if r.random() < edited else w for w in base)) for k in range(n)]


def smallest_reachable(rows: list[tuple[int, str]], words: int, percent: int) -> dict[int, int]:
    sets = {}
    for k, text in rows:
        w = text.split()
        sets[k] = {tuple(w[i:i + words]) for i in range(max(len(w) - words + 1, 1))}
    root = {k: k for k in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def run(spark, rows, words, percent):
    got = bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    return {r["doc_id"]: r["component_id"] for r in got}


@pytest.mark.parametrize("vocabulary", [4000, 12])
def test_family_by_brute_force(spark, vocabulary):
    rows = family(300, edited=0.05, vocabulary=vocabulary)
    assert run(spark, rows, 3, 85) == smallest_reachable(rows, 3, 85)


def test_pairs_grow_with_the_family(spark, monkeypatch):
    plain, counts = bbit_minhash.confirmed, []

    def counted(pairs, sets, percent):
        counts.append(pairs.count())
        return plain(pairs, sets, percent)

    monkeypatch.setattr(bbit_minhash, "confirmed", counted)
    made = []
    for n in (1000, 2000):
        counts.clear()
        run(spark, family(n), 3, 85)
        made.append(sum(counts))
    assert made[1] <= 2.3 * made[0]


def test_several_texts_of_one_id(spark):
    rows = family(60, edited=0.05, vocabulary=12)
    rows += [(3, rows[40][1]), (3, rows[3][1]), (5, "quite another text of five words and some more")]
    got = run(spark, rows, 3, 85)
    assert got[3] == got[40] and set(got) == set(range(60))
    assert run(spark, rows + rows, 3, 85) == got
