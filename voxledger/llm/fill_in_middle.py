"""Fill-in-middle transformation of documents, cut at the ends of lines (or of code points) by a set of boundaries.

The boundaries of a text are offsets in code points, kept as a Roaring-style set: the high bits of an offset name a
container of 2^16 neighbouring offsets, and a container holds the low bits in the smallest of three forms: a sorted
array, a bitmap, or runs. Containers have cumulative cardinalities, so the k-th boundary is found by a search over
containers and a select within one. A text is read a container at a time, so beside the text and its output a document
takes memory for its set only.

The two cuts and the form of a document come from the SHA-256 of ``seed:id``, so a lost row comes out the same again.

Edge cases: null text is the empty text, which is plain; a null id hashes as an empty one; a text that holds a sentinel is
plain; repeated rows are documents of their own; an empty table gives no rows. Only the id and text columns are read, so
others can't clash. Two equal cuts give an empty middle.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Offsets of a container.
SPAN = 1 << 16
#: What marks prefix, suffix and middle in an output.
SENTINELS = ("<P>", "<S>", "<M>")


class ArrayContainer:
    """Low bits as a sorted array."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype("<u2")

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """Low bits as a bitmap of 1024 words, with the ones before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.bitwise_count(self.words).cumsum(dtype=np.int64)])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # without its lowest one
        return at * 64 + (word & -word).bit_length() - 1


class RunContainer:
    """Low bits as runs of neighbours, with the members before each run."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.before = starts, np.concatenate([[0], lengths.cumsum(dtype=np.int64)])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form of sorted low bits: 4 bytes a run, 2 bytes a member, or the bitmap's 8192."""
    heads = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    array, bitmap, runs = 2 * len(low), SPAN // 8, 4 * len(heads)
    if runs < min(array, bitmap):
        return RunContainer(low[heads], np.diff(heads, append=len(low)))
    return ArrayContainer(low) if array <= bitmap else BitmapContainer(low)


class Boundaries:
    """A set of offsets, filled container by container in rising order."""

    def __init__(self):
        self.keys: list[int] = []
        self.containers: list = []
        self.totals: list[int] = []  # members up to and with each container

    def __len__(self) -> int:
        return self.totals[-1] if self.totals else 0

    def add(self, key: int, low: np.ndarray) -> None:
        if len(low):
            self.keys.append(key)
            self.containers.append(container(low))
            self.totals.append(len(self) + len(low))

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 1; the start of the text for 0."""
        if not k:
            return 0
        at = bisect_left(self.totals, k)
        before = self.totals[at - 1] if at else 0
        return self.keys[at] * SPAN + self.containers[at].select(k - before - 1)


def boundaries(text: str, unit: str = "line") -> Boundaries:
    """The ends of a text's units: after each newline and at the text's end, or after each code point."""
    out, n = Boundaries(), len(text)
    for key in range(n // SPAN + 1):
        first = max(key * SPAN, 1)  # offsets of this container that are ends of something
        last = min((key + 1) * SPAN - 1, n)
        if last < first:
            continue
        if unit == "char":
            low = np.arange(first, last + 1) - key * SPAN
        else:
            points = np.frombuffer(text[first - 1 : last].encode("utf-32-le"), "<u4")
            ends = points == 10
            if last == n:
                ends[-1] = True
            low = np.flatnonzero(ends) + first - key * SPAN
        out.add(key, low)
    return out


def draws(seed: int, doc_id: object) -> list[int]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:id``."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[k : k + 8], 16) for k in range(0, 32, 8)]


def rearranged(text: str, form: str, cuts: tuple[int, int], sentinels: tuple[str, str, str] = SENTINELS) -> str:
    if form == "plain":
        return text
    (a, b), (p, s, m) = cuts, sentinels
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that an output was made of. A sentinel has no proper end that is its start, so the first place where one
    is found after the one before it is its own."""
    if form == "plain":
        return output
    p, s, m = sentinels
    second = s if form == "psm" else p
    one = output.index(second, len(p if form == "psm" else s))
    two = output.index(m, one + len(second))
    first, other, middle = output[len(p if form == "psm" else s) : one], output[one + len(second) : two], output[two + len(m) :]
    return first + middle + other if form == "psm" else other + middle + first


def checked(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must be told apart wherever they stand: none holds another, or starts as any of them ends."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a)):
                raise ValueError(f"sentinels {sentinels} can overlap")


def one_document(doc_id: object, text: str | None, seed: int, unit: str, rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, output."""
    text = text or ""
    ends = boundaries(text, unit)
    n, (h1, h2, h3, h4) = len(ends), draws(seed, doc_id)
    if not text or any(s in text for s in sentinels) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    cuts = ends.select(a), ends.select(b)
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return n, form, cuts[0], cuts[1] - cuts[0], rearranged(text, form, cuts, sentinels)


def transform(docs: DataFrame, seed: int = 7, unit: str = "line", rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every text in three at the ends of its units (``line`` or ``char``) and put it in the order prefix-suffix-middle
    or suffix-prefix-middle; ``rate`` percent of the documents are cut, ``spm_rate`` percent of those begin with the suffix.

    Returns ``id_col, n, form, prefix_chars, middle_chars, output`` or, with ``digests``, the SHA-256 of the output and of
    the text rebuilt from it in place of the output. A narrow map: no shuffle.
    """
    checked(sentinels)
    if unit not in ("line", "char"):
        raise ValueError(f"no unit {unit!r}")
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", *(("output_sha256", "restored_sha256") if digests else ("output",))]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, " + ", ".join(f"{c} string" for c in names[5:])
    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            *found, output = one_document(doc_id, text, seed, unit, rate, spm_rate, sentinels)
            yield (*found, hexed(output), hexed(restored(output, found[1], sentinels))) if digests else (*found, output)

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (len(names) - 5)]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                columns = zip(*rows(part))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
