"""Product codes against plain loops, their transform against its definition, and their SQL."""

import hashlib
import math

import duckdb
import numpy as np

from voxledger.llm import queries
from voxledger.llm import vector_codes as V


def plainly(rows, n_parts=8, n_entries=16, rounds=6, scale=4096):
    """rows: (id, vector, label). The contract in plain loops over Python's integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // n_parts) * n_parts
    whole = [[math.floor(scale * x) if abs(x) < 1e15 else int(x) * scale for x in [*v, *[0.0] * (width - len(v))]] for _, v, _ in kept]
    each = width // n_parts
    books = [[v[m * each : (m + 1) * each] for v in whole[:n_entries]] for m in range(n_parts)]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda part, book: min(range(len(book)), key=lambda e: (squared(part, book[e]), e))
    for _ in range(rounds):
        for m in range(n_parts):
            own = [v[m * each : (m + 1) * each] for v in whole]
            at = [best(p, books[m]) for p in own]
            books[m] = [[sum(c) // len(c) for c in zip(*mine)] if (mine := [p for p, a in zip(own, at) if a == e]) else entry for e, entry in enumerate(books[m])]
    out, by_label = [], {}
    for (i, _, label), v in zip(kept, whole):
        codes = [best(v[m * each : (m + 1) * each], books[m]) if each else 0 for m in range(n_parts)]
        error = sum(squared(v[m * each : (m + 1) * each], books[m][c]) for m, c in enumerate(codes))
        by_label[label] = by_label.get(label, 0) + error
        out.append([i, label, "".join(f"{c:02x}" for c in codes), error])
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    fit = lambda x: x if x < 2**63 else None
    return sorted(((i, code, fit(error), fit(by_label[label]), digest) for i, label, code, error in out), key=repr)


def result(spark, rows, **options):
    table = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    return sorted((tuple(r) for r in V.compress(table, **options).collect()), key=repr)


def test_transform_in_sequency_order():
    for n in (1, 2, 4, 8, 16, 64):
        h = V.walsh(np.eye(n, dtype=np.int64))
        assert (h @ h.T == n * np.eye(n)).all()
        assert [int((np.diff(row) != 0).sum()) for row in h.T] == list(range(n))


def test_nearest_is_brute_force_and_adds_less():
    rng = np.random.default_rng(1)
    for n, k, width in ((500, 16, 8), (300, 7, 5), (50, 1, 3), (200, 16, 32), (40, 16, 1)):
        for spread in (1, 3, 4000):
            parts, book = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (k, width))
            book[-1] = book[0]  # ties
            codes, distances, added = V.nearest(parts, book)
            d = ((parts[:, None] - book) ** 2).sum(axis=2)
            assert (codes == d.argmin(axis=1)).all() and (distances == d.min(axis=1)).all()
    smooth = np.cumsum(rng.integers(-9, 10, (500, 32)), axis=1)
    assert V.nearest(smooth, smooth[:16])[2] < 0.6 * 500 * 16 * 32
    huge = rng.integers(-9, 10, (60, 6)).astype(object) * 10**200
    codes, distances, _ = V.nearest(huge, huge[:5])
    d = ((huge[:, None] - huge[None, :5]) ** 2).sum(axis=2)
    assert codes.tolist() == [min(range(5), key=lambda e: (row[e], e)) for row in d] and distances.tolist() == [min(row) for row in d]


def test_limbs_add_up():
    for x in (0, 5, -5, 2**40, -(2**40), 2**39, 3**300, -(3**300)):
        assert sum(v << (V.LIMB * k) for k, v in V.limbs(x)) == x and all(abs(v) < 2**41 for _, v in V.limbs(x))


def test_codes_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(size=16) * 0.2], [None, 1, 2][i % 3]) for i in rng.permutation(150)]
    rows += [(1, rows[0][1], 5), (1, rows[1][1], 5), (None, rows[2][1], None), (500, None, 1), (501, [float("nan")] * 16, 1), (502, [None] * 16, 1), (503, [float("inf")] * 16, 1), (504, [0.0] * 16, None), (505, [-0.0] * 16, 1), (506, [0.1, 0.2], 1), (507, [], 2)]
    assert result(spark, rows) == plainly(rows)
    assert result(spark, rows, n_parts=3, n_entries=4, rounds=2, scale=64) == plainly(rows, 3, 4, 2, 64)


def test_odd_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None, 1)]) == []
    for rows in ([(1, [0.5] * 8, 1)], [(1, [], 1), (2, [], None)], [(i, [0.25] * 8, 1) for i in range(40)], [(i, [10.0 ** (3 * i)] * 8, i % 2) for i in range(90)], [(i, [1e308, -1e308, 3.0 * i], 1) for i in range(20)]):
        assert result(spark, rows) == plainly(rows)


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    cursor = con.execute(queries.ORACLES["op13_vector_codes"])
    names = [d[0] for d in cursor.description]
    got = queries.op13_vector_codes(spark, "/root/testdata/sf0.001")
    assert sorted(names) == sorted(got.columns)
    assert sorted(cursor.fetchall()) == sorted(tuple(r) for r in got.select(*names).collect())
