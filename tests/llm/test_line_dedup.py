"""Line dedup on buckets whose leaders are unlike the near copies in them, and the size of a shingle."""

import itertools
import random

from pyspark.sql import functions as F

from voxledger.llm import line_dedup
from tests.llm.test_llm import docs_of, roots


def shingles(line, size):
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def templated(rng, n):
    """Lines of one template whose fields are random: about 0.5 to 0.75 alike."""
    field = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    return [f"the order with the number {field(5)} has been sent to the customer, thank you for shopping with our store {field(5)}" for _ in range(n)]


def brute_force(texts, size):
    sets = [shingles(t, size) for t in texts]
    return roots(len(sets), [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])


def test_a_large_bucket_of_templated_lines_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 64)
    rng = random.Random(21)
    texts = templated(rng, 400)
    texts += [t[:-1] + c for t in texts[::40] for c in "+-"]
    size = 8
    root = brute_force(texts, size)
    assert sum(r != i for i, r in enumerate(root)) >= 20
    # one key for all lines: a single bucket, whose leader is near to at most a few of them
    rows = line_dedup.lines(docs_of(spark, texts))
    signatures = line_dedup.signatures
    monkeypatch.setattr(line_dedup, "signatures", lambda rows, size: signatures(rows, size).withColumn("keys", F.array(F.lit(1).cast("long"))))
    kept = {r["doc_id"] for r in line_dedup.line_components(docs_of(spark, texts), size).where("kept").collect()}
    assert rows.count() == len(texts) and kept == {i for i, r in enumerate(root) if r == i}


def test_a_changed_character_inside_a_short_line_is_near(spark):
    rng = random.Random(22)
    line = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))
    texts = [line(49 + i) for i in range(30)]
    texts += [t[:24] + "#" + t[25:] for t in texts]
    root = brute_force(texts, 5)
    assert root == [*range(30)] * 2 and brute_force(texts, 8) != root
    kept = {r["doc_id"] for r in line_dedup.line_components(docs_of(spark, texts)).where("kept").collect()}
    assert kept == set(range(30))


def test_chance_of_a_miss_at_the_threshold():
    assert (1 - 0.8**line_dedup.ROWS) ** line_dedup.BANDS <= (1 - 0.8**2) ** 6


def test_partners_in_families_of_one_template_are_found(spark):
    """400 lines of one template, a half to three quarters alike, and for each one partner above the threshold."""
    rng = random.Random(23)
    texts = templated(rng, 400)
    texts += [t[:-1] + "*" for t in texts]
    root = brute_force(texts, 5)
    kept = {r["doc_id"]: r["component_id"] for r in line_dedup.line_components(docs_of(spark, texts)).collect()}
    found = sum(kept[i] == kept[400 + i] for i in range(400))
    assert all(root[i] == root[400 + i] for i in range(400)) and found >= 0.99 * 400
    assert len(set(kept.values())) >= len(set(root))


def test_chance_that_the_count_of_rows_drops_a_pair():
    import math

    least = line_dedup.least_rows(0.8)
    assert sum(math.comb(line_dedup.BINS, t) * 0.8**t * 0.2 ** (line_dedup.BINS - t) for t in range(least)) <= 2e-3


def test_repeated_ids_extra_columns_and_nulls(spark):
    rows = [(1, "first line here\nsecond line here", 5, "a"), (1, "another text of its own\nfirst line here", 5, "b"), (2, "second line here", 6, "c"), (3, None, 7, "d"), (4, "", 8, "e"), (5, "\n\n", 9, "f"), (1, "first line here\nsecond line here", 5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, version string").selectExpr("*", "cast(length(text) as long) as n_chars", "1 as `left`", "2 as gone", "3 as id")
    got = sorted(((r["doc_id"], r["text"], r["n_chars"], r["version"]) for r in line_dedup.dedup(docs).collect()), key=str)
    assert line_dedup.dedup(docs).columns == docs.columns
    assert [g for g in got if g[0] != 1] == [(3, None, None, "d"), (4, "", 0, "e"), (5, "\n\n", 2, "f")]
    ones = [g for g in got if g[0] == 1]
    assert len(ones) == 3 and {t for _, t, _, _ in ones} in ({"first line here\nsecond line here", "another text of its own"}, {"second line here", "another text of its own\nfirst line here"})
    assert all(n == len(t) for _, t, n, _ in ones)
