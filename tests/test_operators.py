"""Golden cases of the operators that SQL on the generic tables doesn't reach."""

import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from voxledger.functions import text as T
from voxledger.operators import ledger as L
from voxledger.operators import phrases as P
from voxledger.operators import precedents as G
from voxledger.operators import returns as R
from voxledger.operators import reviews as V

HEAD = "Example.com Customer reviews 4.3 out of 5 stars 120 global ratings "


def block(author, rating, title, date, body):
    return f"{author} {rating} out of 5 stars {title} Reviewed in the United States on {date} Verified Purchase {body} Helpful Report "


def test_comment_against_reason(spark):
    cases = [
        ("Too large for me", "APPAREL_TOO_LARGE", "SIZE_TOO_LARGE", "Match", "APPAREL_TOO_LARGE"),
        ("wrong size", "ORDERED_WRONG_ITEM", "SIZE_TOO_LARGE", "Mismatch", "SIZE - Too Large"),
        ("does not fit well", "POOR_FIT", "SIZE_ISSUE", "Match", "POOR_FIT"),
        ("fit", "POOR_FIT", "OTHER", "Unclear", "POOR_FIT"),
        ("a leak happened", "DEFECTIVE", "DEFECTIVE", "Match", "DEFECTIVE"),
        ("it has a leak", "DEFECTIVE", "OTHER", "Unclear", "DEFECTIVE"),
        ("doesn't work", "NO_REASON_GIVEN", "DEFECTIVE", "Mismatch", "DEFECTIVE"),
        ("smaller than the picture", None, "SIZE_TOO_SMALL", "Mismatch", "SIZE - Too Small"),
        (None, "DEFECTIVE", "NO_COMMENT", "No Comment", "DEFECTIVE"),
        ("N/A", None, "NO_COMMENT", "No Comment", None),
        (" ok ", "DEFECTIVE", "NO_COMMENT", "No Comment", "DEFECTIVE"),
    ]
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "row_seq int, customer_comments string, reason string")
    got = R.classified(rows).orderBy("row_seq").select("comment_topic", "status", "true_reason").collect()
    assert [tuple(r) for r in got] == [c[2:] for c in cases]


def test_two_reviews_parse(spark):
    text = HEAD + block("Ann Lee", "5.0", "Nice", "March 2, 2026", "Works well.") + block("Bob", "2,0", "Bad", "June 31, 2026", "Fell apart.")
    rows = V.parsed(spark.createDataFrame([("B01_positive", text)], "file_stem string, raw_text string")).orderBy("review_id").collect()
    assert [r["review_id"] for r in rows] == ["B01_positive:1", "B01_positive:2"]
    assert [(r["author"], r["rating"], r["title"], str(r["review_date"]), r["body"]) for r in rows] == [("", 5.0, "Nice", "2026-03-02", "Works well."), ("Bob", 2.0, "Bad", "None", "Fell apart.")]


def test_lost_review_is_counted(spark):
    text = HEAD + block("Ann", "5.0", "Nice", "March 1, 2026", "Good.") + block("Bob", "2.0", "Bad", "March 2, 2026", "Poor.").replace("out of 5", "ou t of 5")
    row = V.parse_stats(spark.createDataFrame([("f", text)], "file_stem string, raw_text string")).first()
    assert (row["expected"], row["parsed"], row["lost"]) == (2, 1, 1)


def test_product_key(spark):
    cases = {"B0FB86T1PJ_ppositive": "B0FB86T1PJ", "B0D4PHX83N_positive +negative": "B0D4PHX83N", "Feel_Positive_Vibes_positive": "Feel_Positive_Vibes", "PositiveVibes": "PositiveVibes"}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.product_key(F.col("s")).alias("k"))
    assert {r["s"]: r["k"] for r in rows.collect()} == cases


def test_normalize_keeps_the_key_form(spark):
    row = spark.createDataFrame([("naïve  café!",)], "t string").select(T.normalize(F.col("t")).alias("n")).first()
    assert row["n"] == "nai ve cafe"


def test_normalize_is_that_of_the_unicode_database(spark):
    """In scripts that every JVM knows: decomposition, case folding and word characters."""
    rng = random.Random(8)
    blocks = [(0x20, 0x7F), (0xA0, 0x250), (0x370, 0x374), (0x388, 0x3CF), (0x400, 0x500), (0x5D0, 0x5EA), (0x620, 0x66F), (0x904, 0x96F), (0xE01, 0xE3A), (0x1E00, 0x1F00), (0x2000, 0x2030), (0x2460, 0x24FF), (0x3041, 0x3096), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0xFB00, 0xFB06), (0xFF01, 0xFF5E), (0x1D400, 0x1D454), (0x1F600, 0x1F640)]
    texts = ["".join(chr(rng.randrange(*rng.choice(blocks))) for _ in range(rng.randrange(1, 15))) for _ in range(4000)] + ["", " ", "Straße ﬁn É ½"]
    plainly = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKD", t).casefold())).strip()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", T.normalize(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == dict(enumerate([*map(plainly, texts), None]))


def test_votes_are_distinct_reviews(spark):
    votes = spark.createDataFrame([("c1", "A", "A:1", "q"), ("c1", "A", "A:2", "q"), ("c2", "A", "A:2", "z"), ("c2", "A", "A:3", "z")], "canonical_id string, product string, review_id string, quote string")
    stored = spark.createDataFrame([("c1", "A", 9), ("x", "A", 3)], "canonical_id string, product string, votes long")
    assert {(r["canonical_id"], r["votes"], r["removed"]) for r in L.reconciled(stored, votes).collect()} == {("c1", 2, 7), ("x", 3, 0)}
    merges = spark.createDataFrame([("c2", "c1")], "merge_id string, keep_id string")
    assert [r["votes"] for r in L.counted(L.merged(votes, merges)).collect()] == [3]


def test_rule_weights_and_soft_rules(spark):
    labels = spark.createDataFrame([("r", "merge")] * 3 + [("r", "keep"), ("", "merge"), (None, "keep"), ("r", "other")], "reason string, label string")
    row = G.soft_rules(G.rule_weights(labels)).first()
    assert (row["n_keep"], row["n_merge"], row["soft"]) == (1, 3, True)


def test_cache_keeps_the_first_answer(spark):
    entries = spark.createDataFrame([("k", "one", 1), ("k", "two", 2), ("j", "three", 3)], "cache_key string, response_text string, seq int")
    assert {(r["cache_key"], r["response_text"]) for r in P.first_written(entries).collect()} == {("k", "one"), ("j", "three")}
    requests = spark.createDataFrame([("k",), ("new",)], "cache_key string")
    assert [r["cache_key"] for r in P.uncached(requests, entries).collect()] == ["new"]


def test_judge_answers_are_read_loosely(spark):
    raw = spark.createDataFrame([("b", 2, 'Here:\n```json\n{"quotes": [{"index": 1, "quote": "good", "categories": ["use", "none"]}, {"index": 3, "quote": "x", "categories": ["use"]}, {"index": 2, "quote": " ", "categories": ["use"]}]}\n```')], "batch_key string, n_reviews int, response_text string")
    categories = spark.createDataFrame([("use",)], "category string")
    assert [(r["index"], r["quote"], r["category"]) for r in P.answered(raw, categories).collect()] == [(1, "good", "use")]


def test_trigrams_take_one_pass_over_long_texts_and_keep_characters_of_two_units(spark):
    texts = ["", "a", "ab cd", "é\U0001d518x \U00020000y", None, "word " * 40_000]
    want = [[] if t is None else list(dict.fromkeys(f" {t} "[i : i + 3] for i in range(len(t)))) for t in texts]
    began = time.time()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.trigrams(F.col("t")).alias("g")).collect()
    assert [r["g"] for r in sorted(rows)] == want
    assert time.time() - began < 15  # a text of 200,000 characters, each place counted from the beginning, takes longer
