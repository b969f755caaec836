"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Rows are handed to the tokenizer in batches of about as many bytes each, whatever the number of texts, and a text longer
than a batch is split at boundaries that no token crosses, so that neither a batch nor a long text sets the memory.

Where a split is safe depends on the vocabulary. Byte-level ones of this family find their pre-tokens with a pattern that
never joins a character to white space after it, nor an ASCII letter or digit to an ASCII character of another kind after
it, and special tokens are never split; the counts of the two sides then add up. Texts for other vocabularies, and
stretches without such a place, are encoded in one go.

Edge cases: null text is the empty text, which has no tokens; special-token strings in a text count as one token, as the
library has it by default; repeated rows are texts of their own; an empty table gives no rows; only the id and text
columns are read, so others can't clash.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.bpe import SPACES

#: Bytes of a batch, and code points from which a text is split.
BATCH, LONG = 1 << 19, 1 << 17
#: Places in a text where the word pattern of byte-level vocabularies always has a boundary.
SAFE = regex.compile(rf"(?<=[^{SPACES}])(?=[{SPACES}])|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{{-~])")


class TokenCounter:
    """Lengths of encodings under one vocabulary file: ``.json`` of tokenizers or ``.model`` of sentencepiece."""

    def __init__(self, path: str):
        self.splits, self.specials = False, None
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.lengths = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
        self.splits = plain and spec.get("normalizer") is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        if added:
            self.specials = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))))

    def stretches(self, text: str, size: int = LONG) -> Iterator[str]:
        """A text in parts of about ``size`` code points whose counts add up to its own."""
        if not self.splits or len(text) <= size:
            yield text
            return
        spans = [m.span() for m in self.specials.finditer(text)] if self.specials is not None else []
        at, k = 0, 0
        while len(text) - at > size:
            end = found.start() if (found := SAFE.search(text, at + size)) else len(text)
            while k < len(spans) and spans[k][1] <= end:
                k += 1
            if k < len(spans) and spans[k][0] < end:  # within a special token: after it
                end = spans[k][1]
            yield text[at:end]
            at = end
        yield text[at:]

    def count(self, texts: Iterable[tuple[str | None, int]], batch: int = BATCH, size: int = LONG) -> list[int]:
        """Tokens of each of ``(text, bytes)``, encoded in batches of at least ``batch`` bytes; a long text is several
        entries, of one batch or more."""
        counts: list[int] = []
        held: list[str] = []
        of: list[int] = []
        weight = 0

        def flush() -> None:
            nonlocal weight
            for i, n in zip(of, self.lengths(held)):
                counts[i] += n
            held.clear()
            of.clear()
            weight = 0

        for text, n_bytes in texts:
            counts.append(0)
            if not text:
                continue
            per_point = n_bytes / len(text)
            for part in self.stretches(text, size):
                held.append(part)
                of.append(len(counts) - 1)
                weight += int(per_point * len(part))
                if weight >= batch:
                    flush()
        if held:
            flush()
        return counts


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    """One counter for each worker process and file."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every whole text; ``vocabulary`` is a path that every executor can open.
    A narrow map without a shuffle: only lengths leave the tasks."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        c = counter(vocabulary)
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            texts = (x.as_py() for x in batch.column(1))  # one at a time
            counts = c.count(zip(texts, sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    sized = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"))
    return sized.mapInArrow(run, schema)
