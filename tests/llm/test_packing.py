from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import packing


def fewest(sizes, capacity):
    """Exact number of bins of a few items."""
    sizes = sorted(sizes, reverse=True)
    if not sizes:
        return 0
    first, rest, best = sizes[0], sizes[1:], len(sizes)
    for n in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in chosen) <= capacity:
                best = min(best, 1 + fewest([s for i, s in enumerate(rest) if i not in chosen], capacity))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=7), st.just(30))
def test_few_items_are_packed_best(sizes, capacity):
    x = np.array(sizes, np.int64)
    bins = packing.bin_completion(x, capacity, 200)
    assert Counter(s for b in bins for s in b) == Counter(sizes) and all(sum(b) <= capacity for b in bins)
    assert len(bins) == fewest(sizes, capacity) >= packing.lower_bound(x, capacity)


def test_search_beats_best_fit():
    # Best-fit decreasing needs three bins, 5 + 3 + 2 and 4 + 3 + 3 are enough.
    x = np.array([5, 4, 3, 3, 3, 2], np.int64)
    assert len(packing.bin_completion(x, 10)) == 2


def test_every_document_is_packed_whole(spark):
    rng = np.random.default_rng(3)
    sizes = [(i, int(n), "x") for i, n in enumerate(rng.integers(0, 70, 400))] + [(1000, None, "x"), (1001, 205, "x"), (1001, 205, "x"), (1002, 50, "x")]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int, lot string")
    windows = spark.createDataFrame([("small", 50), ("large", 120), ("none", 0)], "window_name string, capacity_tokens int")
    packed = packing.pack(df, windows, lot_items=100)
    rows = packed.collect()
    for name, capacity in (("small", 50), ("large", 120)):
        own = [r for r in rows if r.window_name == name]
        room = Counter()
        for r in own:
            room[r.lot, r.bin, r.doc_id if r.lot < 0 else None, r.piece if r.lot < 0 else None] += r.n_tokens
        assert max(room.values()) <= capacity
        got = Counter()
        for r in own:
            got[r.doc_id] += r.n_tokens
            assert r.first_token == r.piece * capacity
        assert got == Counter({i: (n or 0) * (2 if i == 1001 else 1) for i, n, _ in sizes})
        assert all(r.piece == 0 for r in own if r.doc_id != 1001 and r.doc_id < 1000 and dict((a, b) for a, b, _ in sizes)[r.doc_id] <= capacity)
    report = {r.window_name: r for r in packing.packing_report(packed).collect()}
    assert report["small"].tokens == sum(n or 0 for _, n, _ in sizes) and report["large"].used_share > 0.9
    assert packing.pack(df.limit(0), windows).count() == 0
    assert packing.pack(df, windows.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [64, 512])
def test_near_the_lower_bound(capacity):
    rng = np.random.default_rng(5)
    x = np.minimum(rng.lognormal(np.log(capacity / 3), 0.8, 3000).astype(np.int64) + 1, capacity)
    assert len(packing.bin_completion(x, capacity)) <= 1.01 * packing.lower_bound(x, capacity) + 1


def test_the_best_of_up_to_three_items_is_found():
    import itertools
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 90) for _ in range(rng.randint(1, 40))]
        room = rng.randint(1, 200)
        count = np.bincount(sizes, minlength=201)
        best = max((sum(c) for k in range(4) for c in itertools.combinations(sizes, k) if sum(c) <= room), default=0)
        found = packing._top_up(np.flatnonzero(count), count, room)
        assert max(map(sum, found)) == best and all(np.bincount(f, minlength=201)[s] <= count[s] for f in found for s in f)


def test_two_windows_of_one_name(spark):
    sizes = spark.createDataFrame([(i, 40 + i) for i in range(12)], "doc_id long, n_tokens int")
    windows = spark.createDataFrame([("w", 100), ("w", 60)], "window_name string, capacity_tokens int")
    rows = packing.pack(sizes, windows).collect()
    used: dict = {}
    for r in rows:
        used[r.capacity_tokens, r.lot, r.bin] = used.get((r.capacity_tokens, r.lot, r.bin), 0) + r.n_tokens
    assert len(rows) == 24 and all(n <= capacity for (capacity, _, _), n in used.items())
