"""The transducer in segments and chunks: the tokenizer's ids, in constant memory."""

import tracemalloc
from array import array

from tokenizers import Tokenizer

from tests.llm.test_llm import BYTE
from voxledger.llm import bpe


def test_cut_segments_and_chunked_pre_tokens_are_the_tokenizers(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 64)
    monkeypatch.setattr(bpe, "CHUNK", 48)
    t, reference = bpe.Transducer(BYTE), Tokenizer.from_file(BYTE)
    for text in ("plain words, one after another; " * 40, "x" * 1000 + " y  z\n\n " * 30, " " * 500, "日本語" * 200 + " a" * 200, "it's " * 100 + "<|endoftext|>" + " ab" * 90, "aaaa" * 300):
        ids = reference.encode(text, add_special_tokens=False).ids
        assert array("I", t.encode(text)).tolist() == ids
        assert t.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_boundaries_are_those_of_merging():
    t = bpe.Transducer(BYTE)
    tokens = sorted(t.tokens, key=lambda x: (len(x), x))[::97]
    for left in tokens[::7]:
        for right in tokens[::11]:
            assert t.apart(left, right) == (t.merged(left + right) == [left, right])


def test_memory_does_not_grow_with_the_text():
    t, peaks = bpe.Transducer(BYTE), []
    bpe.digest_of(t, "ab cd" * 2000)
    for n in (100_000, 400_000):
        for text in ("abcab" * (n // 5), "ab cd " * (n // 6)):
            tracemalloc.start()
            bpe.digest_of(t, text)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert max(peaks) < 3_000_000, peaks


def test_every_pre_token_goes_through_the_transducer(monkeypatch):
    t, streamed = bpe.Transducer(BYTE), []
    inner = t.stream
    monkeypatch.setattr(t, "stream", lambda chunks: inner(streamed.append(list(chunks)) or iter(streamed[-1])))
    text = "some plain words, 12 of them; naïve 日本 " + "x" * 700
    t.encode(text)
    assert {b"".join(c).decode() for c in streamed} == set(bpe.WORDS.findall(text))


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "twice", 5, "a"), (1, "twice", 6, "b"), (None, "no id", 7, None)], "doc_id long, text string, n_tokens int, ids_sha256 string")
    rows = bpe.encode_decode(docs, BYTE, digests=True).collect()
    assert len(rows) == 3 and len({r["ids_sha256"] for r in rows}) == 2 and rows[0].__fields__ == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
