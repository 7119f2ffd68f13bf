"""The packing plan follows the distinct lengths, not their copies."""
import random
from collections import Counter

from textguard.llm import packing


def test_plan_of_large_groups_of_copies_is_short():
    plan = packing.packing_plan({1800: 50_000, 230: 50_000, 100: 50_000}, 2048)
    assert len(plan) < 10
    used = Counter()
    for pattern, n in plan:
        assert sum(s * k for s, k in pattern) <= 2048
        for s, k in pattern:
            used[s] += n * k
    assert used == {1800: 50_000, 230: 50_000, 100: 50_000}


def test_reduction_has_two_entries_a_length_at_most():
    r = random.Random(3)
    for _ in range(300):
        counts = {r.randint(1, 64): r.randint(1, 1000) for _ in range(r.randint(1, 12))}
        fixed, left = packing.reduce_instance(counts, 64)
        assert len(fixed) <= 2 * len(counts)
        assert all(sum(n * k for pattern, n in fixed for s, k in pattern if s == size) + left.get(size, 0) == many for size, many in counts.items())
