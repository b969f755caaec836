"""The forest on repeated ids, its adaptive depth, and the counts of shared n-grams."""

import itertools
import random

import numpy as np

from voxledger.llm import ngram_join


def text(rng, n=60):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    rng = random.Random(1)
    a, b = text(rng), text(rng)
    rows = [(1, a, 1, "x"), (1, b, 1, "x"), (2, a + " end", 1, "x"), (3, b + " end", 1, "x"), (3, b + " end", 1, "x"), (4, None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c1 int, version string")
    got = sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4)]
    docs = spark.createDataFrame(rows[1:], "doc_id long, text string, c1 int, version string")
    assert {r["component_id"] for r in ngram_join.near_duplicates(docs).where("doc_id = 2").collect()} == {2}


def test_prefixes_are_shortened_until_the_links_found_reach_the_recall(spark, monkeypatch):
    rng, depths = random.Random(2), []
    base = [text(rng, 100).split() for _ in range(40)]
    # one changed word in the middle: five n-grams of 96 differ on either side, 0.90 alike; two: 0.81
    far = [" ".join(w[:30] + ["new"] + w[31:70] + ["new"] + w[71:]) for w in base]
    near = [" ".join(w[:50] + ["new"] + w[51:]) for w in base]
    links_at = ngram_join.links_at
    monkeypatch.setattr(ngram_join, "links_at", lambda classes, docs, depth, *rest: depths.append(depth) or links_at(classes, docs, depth, *rest))
    for changed, recall, last in ((near, 0.9999, 6), (far, 0.99999, 5)):
        depths.clear()
        texts = [" ".join(w) for w in base] + changed
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join.near_duplicates(docs, recall=recall).collect()}
        assert got == {i: (1, i % 40) for i in range(80)} and depths[0] == 6 and depths[-1] <= last


def test_shared_counts_are_those_of_the_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 200, rng.integers(1, 60)).astype(np.uint64)) for _ in range(70)]
    whole = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    within = ngram_join.shared_counts(sets)
    assert all(within[i, j] == whole[i, j] for i, j in itertools.permutations(range(70), 2))
    assert (ngram_join.shared_counts(sets[:30], sets[30:]) == whole[:30, 30:]).all()
