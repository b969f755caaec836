"""The vector join on repeated ids, dense groups, and chunks smaller than a cell."""

import numpy as np

from tests.llm.test_llm import roots
from voxledger.llm import near_vectors


def test_rows_that_repeat_an_id_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [0.01, 1.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5)]
    rows = [(6, [1.0, 0.01]), (7, [0.01, 1.0]), (8, [0.0, 1.0]), (8, [1.0, 0.0]), (6, [1.0, 0.01])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(6, 2, 6), (6, 2, 6), (7, 1, 7), (8, 1, 7), (8, 2, 6)]


def test_chunks_of_a_dense_group_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 40)
    monkeypatch.setattr(near_vectors, "TILE", 16)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(1, 24)) + 0.15 * rng.normal(size=(150, 24)), rng.normal(size=(150, 24)), np.repeat(rng.normal(size=(60, 24)), 2, axis=0) + 0.3 * rng.normal(size=(120, 24))]).astype(np.float32)
    schema = "vec_id long, embedding array<float>, c long, cell int, side int, n string"
    docs = spark.createDataFrame([(i, [float(a) for a in v], 1, 1, 1, "x") for i, v in enumerate(x)], schema)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(docs).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    root = roots(len(x), zip(*np.nonzero(linked)))
    assert linked.sum() > 5000
    assert got == {i: (int(linked[i].sum()), root[i]) for i in range(len(x))}
