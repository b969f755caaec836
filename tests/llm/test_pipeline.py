"""Every stage of the pipeline on nulls, an empty table, repeated rows and extra columns, and what it decides."""

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone string, version int, score double"
STAGES = dict(corpus_pipeline.STAGES)
LONG = " ".join(f"word{i} of the long text" for i in range(60))


def rows():
    texts = [None, "", "a plain line of text\nand another one", "a plain line of text", LONG, LONG + " end", LONG, 'api_key = "Zx9$kLm2!pQr71"', "x" * 5000]
    return [(i, t, None, "s", None if t is None else len(t), "g", 1, 0.5) for i, t in enumerate(texts)] + [(6, LONG, None, "s", len(LONG), "g", 1, 0.5)]


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(2, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_hard_rows(spark, labels, name):
    docs, none = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert STAGES[name](spark, none, labels).count() == 0
    out = STAGES[name](spark, docs, labels)
    if name != "packing":
        assert out.columns == docs.columns
    ids = sorted(r["doc_id"] for r in out.select("doc_id").collect())
    whole = [0, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    if name == "line_dedup":
        assert ids == [0, 1, 2, 4, 5, 7, 8] or ids == [0, 1, 2, 4, 7, 8]
    elif name == "near_copies":
        assert ids == [0, 1, 2, 3, 4, 7, 8]
    elif name == "secrets":
        texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
        assert ids == whole and "Zx9" not in texts[7][0] and texts[7][1] == len(texts[7][0]) and texts[0][0] is None
    elif name == "packing":
        spans = {}
        for r in out.collect():
            spans.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
        assert ids == sorted(ids) and set(ids) == set(whole)
        for s in map(sorted, spans.values()):
            assert s[0][0] == 0 and s[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    else:
        assert ids == whole
