"""Token counts against the libraries, text by text."""

import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.test_llm import BYTE, HARD, WORD
from voxledger.llm import token_counts as T

COUNTER, REFERENCE = T.TokenCounter(BYTE), Tokenizer.from_file(BYTE)
PIECES = ["a", "Z", "word", "'s", "'", "ll", "1", "23", " ", "  ", "\n", "\t", "　", "\x85", "\x1c", "é", "日本", "²", "٣", "😀", "!", "...", "<|endoftext|>", "<|", "|>", "́", "_", "-"]


def plainly(text):
    return len(REFERENCE.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 12))
def test_splits_add_up_to_the_whole(pieces, size):
    text = "".join(pieces)
    parts = list(COUNTER.stretches(text, size))
    assert "".join(parts) == text
    assert COUNTER.count([(text, len(text.encode()))], 1, size) == [plainly(text)]


def test_long_texts_are_split_and_batches_hold_about_as_many_bytes(monkeypatch):
    rng, sent = random.Random(2), []
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(9))) for _ in range(2000)] + ["some words of a long text " * 20_000]
    inner = COUNTER.lengths
    monkeypatch.setattr(COUNTER, "lengths", lambda held: sent.append(sum(len(t.encode()) for t in held)) or inner(held))
    got = COUNTER.count([(t, len(t.encode())) for t in texts], 4096, 2048)
    assert got == [plainly(t) for t in texts]
    assert len(sent) > 100 and max(sent) < 4 * 4096 and sorted(sent)[1] >= 2048


def test_stretches_without_a_safe_place_stay_whole():
    for text in ("x" * 5000, " " * 5000, "日本語" * 2000, "<|endoftext|>" * 800, "٣" * 4000):
        assert COUNTER.count([(text, len(text.encode()))], 100, 50) == [plainly(text)]


def test_rows(spark):
    texts = [*HARD, "ab cd\n" * 60_000, "<|endoftext|>" * 1025, "x " * 512, "x " * 513]
    docs = spark.createDataFrame([(i, t, 7, "c") for i, t in enumerate(texts)] + [(0, "again", 7, "c"), (None, "no id", 7, "c")], "doc_id long, text string, n_tokens int, _bytes string")
    rows = T.count_tokens(docs, BYTE).collect()
    want = sorted((str(i), len((t or "").encode()), plainly(t), plainly(t) > 1024) for i, t in [*enumerate(texts), (0, "again"), (None, "no id")])
    assert sorted((str(r[0]), *r[1:]) for r in rows) == want
    assert T.count_tokens(docs.limit(0), BYTE).collect() == []


def test_other_vocabularies(spark):
    texts = ["Plain words  here", "naïve 日本 text " * 50, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words, path = Tokenizer.from_file(WORD), public_tokenizers.path("piece_bpe_32k.model")
    words.no_truncation()
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    got = lambda p: [r["n_tokens"] for r in T.count_tokens(docs, p).orderBy("doc_id").collect()]
    assert got(WORD) == [len(words.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert got(path) == [len(pieces.encode(t or "")) for t in texts]
