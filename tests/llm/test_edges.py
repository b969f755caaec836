"""Empty tables and extra columns."""

from voxledger.llm import bpe, langid, line_dedup, near_vectors, ngram_join, secret_scan, topk
from tests.llm.test_llm import BYTE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.encode_decode(none, BYTE).count() == 0
    assert secret_scan.scan(none).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0
    assert line_dedup.dedup(none).count() == 0
    assert langid.train(none) == {} and langid.predict(none, {}).count() == 0


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors.near_duplicates(none).count() == 0
    assert topk.top_k(none, none).count() == 0


def test_other_columns_stay_apart(spark):
    rows = [(1, "one two three four five six\nline", "en", "s", 3, "x", 1, "y"), (2, "one two three four five six\nline", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", spans string, line_no int, component string")
    assert secret_scan.scan(docs).columns == ["doc_id", "spans"]
    assert secret_scan.redact(docs).columns == docs.columns
    assert [r["doc_id"] for r in line_dedup.dedup(docs).collect()] == [1]
    assert {r["component_id"] for r in ngram_join.near_duplicates(docs).collect()} == {1}
