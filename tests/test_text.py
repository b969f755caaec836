"""Shortcuts of the text kernel: what they skip, and what they must not."""

import re
import string

from pyspark.sql import functions as F

from voxledger.functions import text as T


def test_words_that_end_otherwise_have_no_suffix():
    assert all(x.endswith(tuple(T.LEAST_SUFFIXES)) for x in T.SUFFIXES)


def test_ascii_is_normalised_and_idioms_are_found(spark):
    texts = [f"A{c}b{c}{c}Z_9" for c in map(chr, range(1, 128))] + [string.punctuation, "It does THE job!", "quick fix", "a quick one to fix", "right tools for the job"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.normalize(F.col("t")).alias("n"), T.idiom_fired(F.col("t")).alias("i")).collect()
    for r in rows:
        assert r.n == re.sub("[^a-z0-9_]+", " ", r.t.lower()).strip(" ")
    assert {r.t for r in rows if r.i} == {"It does THE job!", "quick fix", "right tools for the job"}
