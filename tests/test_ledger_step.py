"""The ledger's step and the operators on it: what is read, joined and shuffled, and that results stay."""

from pyspark.sql import functions as F

from voxledger.functions.text import normalize
from voxledger.operators import decisions as D
from voxledger.operators import ledger as L
from voxledger.operators import phrases as P
from voxledger.operators.lineage import looked_up
from voxledger.plans import bindings as B

SF = "/root/testdata/sf0.001"
VOTES = "canonical_id string, product string, review_id string, quote string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_that_are_read_again_are_not_made_again(spark):
    groups, canonicals, _ = B.ledger(spark, SF, again=True)
    assert "parquet" not in plan(groups) + plan(canonicals)
    for one, two in zip(B.ledger(spark, SF), (groups, canonicals)):
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_texts_without_words_are_told_as_by_normalising(spark, monkeypatch):
    quotes = ["plain", "\u2122", "\ufe70", "?!", "\u00e9", "_", "7", "\u2463", "\u0345"]
    rows = spark.createDataFrame([(q, "en", "p", str(i), i) for i, q in enumerate(quotes)], "quote string, category string, product string, review_id string, phrase_seq long")
    monkeypatch.setattr(B, "phrases", lambda spark, sf_dir: rows)
    got = {r["quote"]: r["text"] for r in B.worded(spark, SF).collect()}
    assert got == {r["quote"]: r["text"] for r in rows.withColumn("text", normalize(F.col("quote"))).where("text <> ''").collect()} and "?!" not in got


def test_rows_without_a_key_are_spread(spark):
    rows = spark.range(1000).select(F.col("id").cast("string"), F.when(F.col("id") < 2, "k").alias("key"))
    table = spark.createDataFrame([("k", 1)], "of string, v int").hint("merge")
    out = looked_up(rows, "key", "id", table, "of")
    assert out.count() == 1000 and out.where("v = 1").count() == 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = looked_up(rows, "key", "id", table, "of").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 600


def test_votes_of_a_row_are_those_of_its_products(spark):
    votes = spark.createDataFrame([("c", "A", "1", "q"), ("c", "A", "1", "r"), ("c", "B", "1", "q"), ("c", None, "1", "q"), ("c", "A", "", "q"), ("d", "A", None, "q")], VOTES)
    want = {(r["canonical_id"], r["v"]) for r in L.counted(votes).groupBy("canonical_id").agg(F.sum("votes").alias("v")).collect()}
    assert {(r["canonical_id"], r["votes"]) for r in L.voted(votes).collect()} == want == {("c", 3)}


def test_context_takes_the_limit_before_rows_meet(spark):
    n = 30
    groups = spark.createDataFrame([("g", "en", "works")], "group_id string, category string, name string")
    rows = spark.createDataFrame([(f"c{i}", "g", f"t{i:02}", i) for i in range(n)], "canonical_id string, group_id string, text string, ord int")
    votes = spark.createDataFrame([(f"c{i}", "A", str(j), "q") for i in range(n) for j in range(1 + i // 10)], VOTES)
    out = L.context(groups, rows, votes)
    assert "WindowGroupLimit" in plan(out)
    got = out.first()
    assert (got["total"], got["more"]) == (60, 18) and got["shown"] == " / ".join(f"t{i}" for i in [*range(20, 30), 10, 11])


def test_totals_do_not_shuffle_rows_for_the_rollup(spark):
    groups = spark.createDataFrame([("g", "en"), ("h", "en"), ("i", None)], "group_id string, category string")
    rows = spark.createDataFrame([("c", "g"), ("d", "g"), ("e", "h"), ("f", "i")], "canonical_id string, group_id string")
    votes = spark.createDataFrame([(c, p, r, "q") for c, p, r in ["cA1", "cA2", "cB1", "dA1", "eA1", "fA1", "fA2"]], VOTES)
    out = L.totals(groups, rows, votes)
    cells = L.counted(votes).join(rows, "canonical_id").join(groups, "group_id")
    want = cells.rollup("category", "group_id", "canonical_id").agg(F.sum("votes").alias("votes"))
    assert sorted(map(repr, out.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    expand = [x for x in plan(out).splitlines() if "Expand" in x]
    assert expand and not any("canonical_id" in x for x in expand)


def test_unique_phrases_shuffle_marks(spark):
    schema = "quote string, category string, product string, review_id string, phrase_seq int"
    said = [("Fits well.", "en", "A", "1", 1), ("fits WELL", "en", "A", "1", 2), ("fits well", "en", "B", "", 3), ("fits well", None, "A", "2", 4), (None, "en", "A", "3", 5), (None, None, None, None, 6)]
    out = P.unique_phrases(spark.createDataFrame(said, schema))
    got = {(r["category"], r["norm"], r["product"]): (r["n"], r["quotes"], r["reviews"], r["total"], r["text"], r["first_seq"]) for r in out.collect()}
    assert got == {("en", "fits well", "A"): (2, 2, 1, 3, "Fits well.", 1), ("en", "fits well", "B"): (1, 1, 0, 3, "Fits well.", 1), (None, "fits well", "A"): (1, 1, 1, 1, "fits well", 4), ("en", None, "A"): (1, 0, 1, 1, None, 5), (None, None, None): (1, 0, 0, 1, None, 6)}
    assert not any("Expand" in x and "key_text" in x or "Aggregate" in x and "norm#" in x.split("],")[0] for x in plan(out).splitlines())


def test_second_places_look_names_and_texts_up_once(spark):
    groups = spark.createDataFrame([("g1", "en", "Fit", 1), ("g2", "en", "Price", 2)], "group_id string, category string, name string, ord int")
    rows = spark.createDataFrame([("c1", "g1", "fits", 1), ("c2", "g2", "cheap", 2)], "canonical_id string, group_id string, text string, ord int")
    told = [("1", "g2", None, None, None), ("2", "gone", "PRICE", None, None), ("3", None, "Colour", None, None), ("4", None, None, "c2", None), ("5", None, None, "gone", "Cheap!"), ("6", None, None, None, "nowhere"), ("7", None, None, None, None), ("8", None, "Shade", None, "fits")]
    pending = spark.createDataFrame([(i, None if i == "8" else "en", f"text {i}") for i, *_ in told], "id string, category string, text string")
    placed = pending.select("id", F.concat(F.lit("new:"), "id").alias("row_key"), F.lit("g1").alias("group_key"))
    decisions = spark.createDataFrame(told, "id string, second_group_id string, second_group_new_name string, second_canonical_id string, second_canonical_text string")
    got = {(r["id"], r["row_key"], r["group_key"], r["how"]) for r in D.placed_again(placed, pending, decisions, rows, groups).collect()}
    assert got == {("1", "new:g2|text 1", "g2", "second_group"), ("2", "new:g2|text 2", "g2", "second_group"), ("3", "new:new|en|colour|text 3", "new|en|colour", "second_group"), ("4", "c2", "g2", "second_row"), ("5", "c2", "g2", "second_row"), ("8", "new:new|shade|text 8", "new|shade", "second_group"), ("8", "c1", "g1", "second_row")}
