"""Nearest vectors over tiles against all pairs."""

import numpy as np
import pytest

from voxledger.operators import cosine as C

KIND = "id int, category string, v array<float>"


def plainly(left, right, k, floor, without=()):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1.0)
    out = set()
    for i, c, v in left:
        found = sorted((-round(float((unit(v) * unit(w)).sum()), 12), j) for j, d, w in right if c is not None and c == d and i != j and (i, j) not in without)
        out |= {(i, j, n + 1) for n, (s, j) in enumerate([f for f in found if -f[0] >= floor][:k])}
    return out


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_tiles_find_what_all_pairs_do(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    rows = [(i, [None, "a", "b"][min(2, i % 5)], [float(x) for x in centres[i % 6] + spread * rng.normal(size=5)]) for i in range(260)]
    rows += [(900, "a", rows[1][2]), (901, "a", rows[1][2]), (902, "a", [0.0] * 5), (903, "alone", [1.0] * 5)]
    table = spark.createDataFrame(rows, KIND)
    without = {(i, (i * 7) % 260) for i in range(0, 260, 2)}
    gone = spark.createDataFrame(sorted(without), "l int, r int")
    for w, d in ((None, ()), (gone, without)):
        got = {tuple(r) for r in C.cosine_shortlist(table, table, without=w, tile=16, pivots=4).collect()}
        assert got == plainly(rows, rows, 3, 0.35, d)
    some = [r for r in rows if r[0] % 3 == 0]
    assert {tuple(r) for r in C.cosine_shortlist(spark.createDataFrame(some, KIND), table, 2, 0.9, tile=8).collect()} == plainly(some, rows, 2, 0.9)


def test_far_tiles_are_not_met(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(i, "a", [float(x) for x in centres[i // 50] + 0.01 * rng.normal(size=8)]) for i in range(600)]
    table, tiles, met = spark.createDataFrame(rows, KIND), [], C.met
    monkeypatch.setattr(C, "met", lambda a, b, pairs, *x: tiles.append(pairs.count()) or met(a, b, pairs, *x))
    C.cosine_shortlist(table, table, tile=10).collect()
    assert sum(tiles) < 60 * 60 / 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame([(1, "a", [1.0, 0.0])], KIND)
    assert C.cosine_shortlist(none, some).count() == C.cosine_shortlist(some, none).count() == C.cosine_shortlist(some, some).count() == 0
