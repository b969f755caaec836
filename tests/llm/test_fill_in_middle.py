"""Fill-in-middle against the pattern that defines its units, its set against a sorted list, and its SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from voxledger.llm import fill_in_middle as M
from voxledger.llm import queries

HARD = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "é日😀\n\n😀x", "x<P>y\nz", "<\nP><S\n>", "\r\nx y\x00\n", "word " * 30_000, "ab\n" * 70_000, "\n" * 140_000, ("x" * 66_000 + "\n") * 3 + "end", "same\ntext", "same\ntext"]


def plainly(doc_id, text, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    lines = re.findall(unit, text)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return len(lines), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("density", [0, 1, 300, 4096, 4097, 30_000, 65_536])
def test_every_container_selects_as_a_sorted_list(density):
    rng = np.random.default_rng(density)
    for low in (np.sort(rng.choice(M.SPAN, density, replace=False)), np.arange(density)):
        if density:
            c = M.container(low)
            size = min(2 * density, 8192, 4 * (1 + int((np.diff(low) > 1).sum())))
            assert size == {M.ArrayContainer: 2 * density, M.BitmapContainer: 8192, M.RunContainer: 4 * len(getattr(c, "starts", []))}[type(c)]
            for k in {0, density // 3, density - 1}:
                assert c.select(k) == low[k]


def test_selection_over_containers_is_the_pattern_s():
    rng = random.Random(5)
    texts = [t or "" for t in HARD] + ["".join(rng.choice("ab\né") for _ in range(n)) for n in (7, 65_535, 65_536, 65_537, 200_000)]
    for text in texts:
        for unit, pattern in (("line", r"[^\n]*\n|[^\n]+"), ("char", r"(?s).")):
            ends = [m.end() for m in re.finditer(pattern, text)]
            b = M.boundaries(text, unit)
            assert len(b) == len(ends)
            for k in [0, *sorted({1, len(ends) // 2, len(ends)} & set(range(1, len(ends) + 1)))]:
                assert b.select(k) == (ends[k - 1] if k else 0)


def test_dense_ends_make_runs_and_bitmaps():
    assert {type(c) for c in M.boundaries("\n" * 140_000).containers} == {M.RunContainer}
    assert {type(c) for c in M.boundaries("ab\n" * 70_000).containers} >= {M.BitmapContainer}
    assert {type(c) for c in M.boundaries("a line of text\n" * 9000).containers} >= {M.ArrayContainer}


def test_documents_are_cut_and_restored(spark):
    docs = spark.createDataFrame([(i, t, "y", 4) for i, t in enumerate(HARD)] + [(3, "twice\nthe id", "z", 5)], "doc_id long, text string, form string, n int")
    got = {(r["doc_id"], r["output"]): r for r in M.transform(docs).collect()}
    digests = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in M.transform(docs, digests=True).collect()}
    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, text in [*enumerate(HARD), (3, "twice\nthe id")]:
        want = plainly(i, text)
        r = got.pop((i, want[-1]))
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == want[:4]
        assert M.restored(r["output"], r["form"]) == (text or "")
        assert (i, hexed(want[-1]), hexed(text or "")) in digests
    assert not got
    assert M.transform(docs.limit(0)).count() == 0
    assert M.transform(spark.createDataFrame([(None, "a\nb")], "doc_id long, text string")).first()["doc_id"] is None


def test_other_rates_and_units(spark):
    docs = spark.createDataFrame([(i, f"text {i}\nof lines") for i in range(300)], "doc_id long, text string")
    forms = [r["form"] for r in M.transform(docs, unit="char", rate=50, spm_rate=0, sentinels=("[pre]", "[suf]", "[mid]")).collect()]
    assert 100 < forms.count("plain") < 200 and "spm" not in forms
    for bad in (("<P>", "<S>", "<P>x"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            M.transform(docs, sentinels=bad)


def test_sql_agrees(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(HARD) if t is None or len(t) < 300]
    docs = spark.createDataFrame(rows + [(i, t) for i in range(100, 160) for t in ("a\nbé\n\nlast", "one\n")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(queries.ORACLES["op11_fill_in_middle"])
    names = [d[0] for d in cursor.description]
    got = queries.op11_fill_in_middle(spark, str(tmp_path))
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*names).collect())
