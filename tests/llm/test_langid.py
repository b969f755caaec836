"""Letters beyond the first 65,536 code points."""

from voxledger.llm import langid


def test_text_of_emoji_is_und(spark):
    schema = "doc_id long, text string, lang string"
    model = langid.train(spark.createDataFrame([(0, "anna banana", "aa"), (1, "\U0001F600 \U0001F680\U0001F600", "bb")], schema))
    assert set(model) == {"aa"}
    rows = langid.predict(spark.createDataFrame([(0, "\U0001F600\U0001F680 12", None), (1, "\U0001F600 banana", None)], schema), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows][0] == ("und", 0.0) and rows[1]["lang_pred"] == "aa"


def test_high_letters_are_letters():
    profile = langid.Profile(64, 3, 7)
    assert profile.grams("\U0001F600") is None and profile.grams("\U00020000\U0001F600") is not None
    a, b = profile.grams("ab\U0001F600cd"), profile.grams("ab cd")
    assert [x.tolist() for x in a] == [x.tolist() for x in b]
