"""Packing plans against the optimum."""

import random
from collections import Counter

from tests.llm.test_llm import WORD
from voxledger.llm import packing


def fewest(items, size):
    """Fewest sequences, by trying every place for every piece."""
    best = len(items)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(items):
            best = len(rooms)
            return
        for k in {r: i for i, r in enumerate(rooms) if r >= items[at]}.values():
            place(at + 1, [r - items[at] * (i == k) for i, r in enumerate(rooms)])
        place(at + 1, [*rooms, size - items[at]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


def checked(items, size, **how):
    found = packing.plan(Counter(items), size, **how)
    assert Counter(x for lengths, times in found.fillings for x in lengths * times) == Counter(items)
    assert all(sum(lengths) <= size and times > 0 for lengths, times in found.fillings)
    return sum(times for _, times in found.fillings), found.gap


def test_plan_that_filling_in_turn_misses():
    items = [995, 964, 860, 785, 764, 756, 738, 621, 523, 489]
    assert sum(t for _, t in packing.fill_in_turn(Counter(items), 2048)) == 5
    assert checked(items, 2048) == (4, 0)


def test_plans_are_best():
    rng = random.Random(31)
    for _ in range(150):
        size = rng.choice([20, 60, 100])
        items = [rng.randrange(1, rng.choice([size // 2, size]) + 1) for _ in range(rng.randrange(1, 10))]
        items += rng.choices(items, k=2)
        best = fewest(items, size)
        assert checked(items, size) == (best, 0) and packing.lower_bound(Counter(items), size) <= best


def test_a_spent_budget_reports_its_gap_and_is_no_worse_than_best_fit():
    rng = random.Random(32)
    for _ in range(20):
        items = [rng.randrange(200, 1100) for _ in range(60)]
        n, gap = checked(items, 2048, budget=50)
        assert n <= sum(t for _, t in packing.best_fit(Counter(items), 2048))
        assert 0 <= gap <= n - packing.lower_bound(Counter(items), 2048)


def test_many_pieces_take_no_longer():
    items = {x: 10**9 + x for x in range(1, 2049)}
    found = packing.plan(items, 2048)
    used = Counter()
    for lengths, times in found.fillings:
        for x in lengths:
            used[x] += times
    assert used == items


def test_pieces_above_a_third_are_bounded_by_pairs():
    assert packing.plan(Counter({k: 9 for k in range(690, 1101, 7)}), 2048).gap == 0


def test_very_many_small_pieces_in_a_large_sequence():
    found = packing.plan({2: 2048 * 5000}, 4097)
    assert sum(times for _, times in found.fillings) == 5000


def test_ties_long_texts_and_clashing_columns(spark):
    texts = ["word " * 9000, "same", "same", "", None]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)] + [(1, "same", 2, "t")], "doc_id long, text string, length int, gap string")
    rows = packing.pack_documents(docs, WORD, 256).collect()
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 0)
    assert [s for _, s, _ in long] == [256 * k for k in range(len(long))] and len(rows) == len(long) + 5
