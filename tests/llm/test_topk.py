"""The threshold algorithm against brute force, where its bound can stop it and where it can't."""

import numpy as np

from voxledger.llm import topk


def brute_force(items, ids, query, own, k):
    scores = items @ query
    found = np.flatnonzero(ids != own)
    found = found[np.lexsort((ids[found], -scores[found]))][:k]
    return [(int(ids[i]), int(scores[i])) for i in found]


def test_exact_on_every_kind_of_table():
    rng = np.random.default_rng(3)
    tables = [rng.normal(size=(300, 8)) * 256, rng.normal(size=(2000, 16)) * np.exp(rng.normal(size=(2000, 1))) * 256, rng.integers(-2, 3, (60, 3)), rng.normal(size=(1, 4)) * 9, np.zeros((7, 5)), np.abs(rng.normal(size=(400, 6))) * 1e8]
    for x in tables:
        items, ids = np.floor(x).astype(np.int64), rng.permutation(len(x))
        lists = topk.Lists(items, ids)
        for i in range(0, len(x), max(1, len(x) // 25)):
            for query in (items[i], -items[i], np.zeros_like(items[i])):
                assert lists.best(query, int(ids[i]), 5)[0] == brute_force(items, ids, query, int(ids[i]), 5)


def test_the_bound_stops_where_components_or_lengths_differ():
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(4000, 16)) * np.exp(rng.normal(size=(4000, 1))), rng.normal(size=(4000, 24)) / np.arange(1, 25) ** 1.5):
        items = np.floor(256 * x).astype(np.int64)
        lists = topk.Lists(items, np.arange(len(items)))
        met = [lists.best(items[i], i, 5)[1] for i in range(0, 4000, 100)]
        assert np.mean(met) < 0.6 * len(items)


def test_repeated_rows_and_other_columns(spark):
    rows = [(0, [1.0, 0.5], "a", 1), (50, [1.0, 0.5], "b", 1), (1, [1.0, 0.5], "c", 1), (1, [0.5, 0.5], "d", 1), (2, None, "e", 1), (3, [float("nan"), 1.0], "f", 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int")
    got = [tuple(r) for r in topk.top_k(vectors.where("vec_id % 50 = 0"), vectors).orderBy("query_id", "rank").collect()]
    s = 256 * 256 + 128 * 128
    assert got == [(0, 1, 1, s), (0, 2, 50, s), (0, 3, 1, 256 * 128 + 128 * 128), (50, 1, 0, s), (50, 2, 1, s), (50, 3, 1, 256 * 128 + 128 * 128)]
