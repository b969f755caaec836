"""The fitted operators on documents that they did not learn from, as their queries split them; and hard rows."""

import pytest

from voxledger.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
#: sf0.01 holds out six toxic documents only, two of which score low there.
SIZES = {"quality": SF, "toxic": "/root/testdata/sf0.1"}


def auc(rows):
    """Chance that a row of class 1 scores above one of class 0."""
    ones, zeros = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    assert ones and zeros
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / len(ones) / len(zeros)


@pytest.mark.parametrize("query, label, least", [("op5_quality", "quality", 0.95), ("op8_toxicity", "toxic", 0.95)])
def test_scores_order_held_out_labels(spark, query, label, least):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SIZES[label]}/labels.parquet").collect()}
    rows = queries.QUERIES[query](spark, SIZES[label]).where("held_out").collect()
    assert auc([(r["score"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]) >= least
    told = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    assert sum(p == y for p, y in told) >= 0.9 * len(told)


def test_held_out_languages(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op10_langid"](spark, SF).where("held_out and lang_pred <> 'und'").collect()
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def test_labels_without_documents_and_repeated_labels(spark):
    docs = spark.createDataFrame([(1, "good day"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (7, 1)], "doc_id long, toxic int")
    assert [r["score"] < 0.01 for r in toxicity.predict(docs, toxicity.learn(docs, labels)).collect()] == [True] * 3
    some = spark.createDataFrame([(i, f"note{i} you{i} fool today{i} and more" if i % 2 else f"a fine day number {i}") for i in range(40)] * 2, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, toxic int")
    scored = toxicity.predict(some.withColumn("score", some.doc_id), toxicity.learn(some, marks)).collect()
    assert len(scored) == 80 and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in scored)


def test_misspelled_terms():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "hate": 1.0, "abominable": 1.5, "scumbagworthless": 3.0, "dumb": 1.0})
    assert lexicon.find("you*idiot") == lexicon.find("loser#idiot") == lexicon.find("a@" * 30 + "idiots") == (2.0, 0)  # a part is a term
    assert lexicon.find("z" * 90) is None and lexicon.find("so*what") is None
    assert all(lexicon.find(w) for w in ("idiot", "id1ot", "idiots", "hateful", "abomminable", "abominabel", "scumbagwortless", "d*mb"))
    assert not any(lexicon.find(w) for w in ("hatelepathic", "late", "abc123", "dune", "1234"))


def test_statistics_and_languages_of_hard_rows(spark):
    texts = [None, "", " \n", "x" * 300_000, "word " * 60_000, "日本語", "😀😀"]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, stats string, lang_pred string")
    rows = quality.with_statistics(docs).collect()
    assert all(len(r["stats"]) == len(quality.STATISTICS) for r in rows)
    prototypes = langid.train(docs.selectExpr("'en' as lang", "text"))
    got = [r["lang_pred"] for r in langid.predict(docs.drop("lang_pred"), prototypes).orderBy("doc_id").collect()]
    assert got == ["und", "und", "und", "en", "en", "en", "und"]
