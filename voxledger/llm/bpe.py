"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as a byte-to-text machine.

Why it can stream. Merging never crosses a boundary that the final encoding has, so the part of an
encoding before a boundary is the encoding of the text before it. Every token has at most
``lookahead`` bytes (the longest token the merge list builds), so the final encoding has a boundary
at one of the last ``lookahead`` positions read, and the tokens that the encodings of all those
prefixes share are stable: they can be emitted and forgotten. For each prefix only its last token is
kept: among the tokens that end there it is the one that its own bytes merge to and that, after the
last token of what precedes it, is not merged across. Memory is O(lookahead), whatever the length.

Every pre-token goes through the transducer. A text is read in segments that no pre-token crosses, and a pre-token longer
than a segment in chunks; ids leave in blocks, which go to their digest and to the decoder as they come. So beside the
text itself a document takes constant memory, unless its ids are asked for. What the transducer says of short stretches
is kept for the next time, up to CACHE_ENTRIES of them.

Edge cases: null text is the empty text, which has no ids; special-token strings in a text become
their id, as the reference library does with its defaults; ties cannot arise (ranks are distinct).
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the word pattern that byte-level vocabularies of this family are defined with.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: A blank beside another white-space character: there a text is not cut at its blanks.
UNEVEN = regex.compile(rf"\x20[{SPACES}]|[{SPACES}]\x20|^\x20|\x20$")
#: A single blank between other characters starts a pre-token: texts may be cut there.
CUT = regex.compile(rf"(?<=[^{SPACES}])\x20(?=[^{SPACES}])")
#: Entries that a worker keeps of encoded stretches, about 150 bytes each (90 MB), and of boundaries between tokens; once
#: full, the rest is worked out anew.
CACHE_ENTRIES, JOIN_ENTRIES = 600_000, 200_000
#: Characters of a segment, at least, and of a chunk of a longer pre-token; ids of a block, at least.
SEGMENT, CHUNK, BLOCK = 1 << 15, 1 << 12, 1 << 12


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1 bytes
    stand for themselves, the others take the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Encoder over one merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        raw = lambda s: bytes(back[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.specials.items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault((raw(a), raw(b)), i)
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.made_of: dict[bytes, tuple[int, bytes, bytes]] = {}
        made = {a + b for a, b in self.ranks} | {bytes([b]) for b in range(256)}
        self.lookahead = max(map(len, made))
        #: Tokens that their own bytes merge to; no other ever ends a prefix.
        self.tokens = {t for t in made if self.merged(t) == [t]}
        self.seen: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Merges in order of rank; used on one token's bytes at a time, whose number is bounded."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank, never = self.ranks.get, 1 << 40
        order = [rank(pair, never) for pair in zip(parts, parts[1:])]
        while order and (best := min(order)) < never:
            at = order.index(best)
            if len(parts) == 2:
                self.made_of[data] = (best, *parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = rank((parts[at - 1], parts[at]), never)
            if at < len(order):
                order[at] = rank((parts[at], parts[at + 1]), never)
        return parts

    def beside(self, left: bytes, right: bytes) -> bool:
        """Whether the boundary between two adjacent tokens survives merging."""
        if (ok := self.joins.get((left, right))) is None:
            ok = self.apart(left, right)
            if len(self.joins) < JOIN_ENTRIES:
                self.joins[left, right] = ok
        return ok

    def apart(self, left: bytes, right: bytes) -> bool:
        """Merging is undone from its end, the later merge first: at no time may the two parts at the boundary have had
        a merge that came before the one undone. Among equal ranks the leftmost comes first."""
        rank, never = self.ranks.get, 1 << 40
        until = never
        while True:
            if rank((left, right), never) < until:
                return False
            a, b = self.formed(left), self.formed(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                until, left = a[0], a[2]
            else:
                until, right = b[0] + 1, b[1]

    def formed(self, token: bytes) -> tuple[int, bytes, bytes] | None:
        """Rank and parts of the last merge that makes a token of its bytes; None for a byte."""
        if len(token) == 1:
            return None
        if token not in self.made_of:
            self.merged(token)
        return self.made_of[token]

    def extend(self, window: bytes, last: list, first: bool) -> None:
        """Add to ``last`` the last token of each further prefix of the window; ``first`` says that the pre-token starts
        with the window."""
        tokens, joins, most = self.tokens, self.joins, self.lookahead
        for n in range(len(last) + 1, len(window) + 1):
            found = None
            for at in range(n - most if n > most else 0, n):
                if (token := window[at:n]) in tokens:
                    if not at:
                        ok = first
                    elif (left := last[at - 1]) is None:
                        continue
                    elif (ok := joins.get((left, token))) is None:
                        ok = self.beside(left, token)
                    if ok:
                        found = token
                        break
            last.append(found)

    def stream(self, chunks: Iterable[bytes]) -> Iterator[bytes]:
        """Tokens of one pre-token whose bytes arrive in chunks, each as soon as it is stable."""
        window, last, first, emitted, most = b"", [], True, 0, self.lookahead
        for chunk in chunks:
            for k in range(0, len(chunk), 4 * most):
                window += chunk[k : k + 4 * most]
                self.extend(window, last, first)
                if len(window) >= 8 * most:
                    for token in self.shared(last, emitted):
                        emitted += len(token)
                        yield token
                    keep = emitted - most  # the tokens before the boundary are still asked for
                    if keep > 0:
                        window, last, emitted, first = window[keep:], last[keep:], most, False
        yield from self.tail(last, emitted)

    def tail(self, last: list, emitted: int) -> list[bytes]:
        """Tokens from ``emitted`` to the end."""
        out, at = [], len(last)
        while at > emitted:
            out.append(last[at - 1])
            at -= len(last[at - 1])
        return out[::-1]

    def shared(self, last: list, emitted: int) -> list[bytes]:
        """Tokens from ``emitted`` on that the encodings of the last ``lookahead`` prefixes all have."""
        live = {n for n in range(len(last) - self.lookahead + 1, len(last) + 1) if last[n - 1] is not None}
        while len(live) > 1:  # the furthest end goes back by a token until all meet
            far = max(live)
            live.discard(far)
            live.add(far - len(last[far - 1]))
        return self.tail(last[: live.pop()], emitted)

    def piece(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of a stretch that no pre-token crosses."""
        if (ids := self.seen.get(text)) is None:
            words = WORDS.findall(text)
            ids = b"".join(map(self.piece, words)) if len(words) > 1 else self.word(text)
            if len(text) <= 40 and len(self.seen) < CACHE_ENTRIES:
                self.seen[text] = ids
        return ids

    def word(self, text: str) -> bytes:
        """Ids of one pre-token."""
        return array("I", [self.ids[t] for t in self.stream((text.encode(),))]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        return b"".join(self.encode_stream(text))

    def encode_stream(self, text: str | None) -> Iterator[bytes]:
        """Ids of a whole text in blocks, each as soon as its ids are stable."""
        if not text:
            return
        at = 0
        for m in self.special_pattern.finditer(text) if self.special_pattern is not None else ():
            yield from self.encode_plain(text, at, m.start())
            yield self.specials[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self.encode_plain(text, at, len(text))

    def encode_plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        first = True
        while at < end:
            cut = at + SEGMENT
            cut = found.start() if cut < end and (found := CUT.search(text, cut, end)) else end
            if cut - at > 2 * SEGMENT:
                yield from self.encode_long(text, at, cut)
            else:
                yield self.encode_segment(text[at:cut], not first)
            at, first = cut, False

    def encode_long(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """A stretch without a place to cut: pre-token by pre-token, long ones in chunks."""
        held = array("I")
        for m in WORDS.finditer(text, at, end):
            a, b = m.span()
            for token in self.stream(text[k : min(b, k + CHUNK)].encode() for k in range(a, b, CHUNK)):
                held.append(self.ids[token])
                if len(held) >= BLOCK:
                    yield held.tobytes()
                    held = array("I")
        yield held.tobytes()

    def encode_segment(self, text: str, from_cut: bool) -> bytes:
        """A short stretch; one that starts at a cut starts with a blank that starts a pre-token."""
        if UNEVEN.search(text, 1 if from_cut else 0):
            pieces = WORDS.findall(text)
        else:  # every blank then starts a pre-token, so the text may be cut there
            start, *rest = text.split(" ")
            pieces = [*([] if from_cut else [start]), *[" " + p for p in rest]]
        seen = self.seen
        return b"".join([seen[p] if p in seen else self.piece(p) for p in pieces])

    def decode(self, ids: Iterable[int]) -> str:
        machine = Decoder(self)
        return machine.feed(ids) + machine.end()


class Decoder:
    """Text of ids, block by block, through an incremental UTF-8 machine: a code point cut between two tokens waits for
    its last byte, and impossible bytes become U+FFFD."""

    def __init__(self, transducer: Transducer):
        self.machine, self.table = codecs.getincrementaldecoder("utf-8")("replace"), transducer.bytes_of

    def feed(self, ids: Iterable[int]) -> str:
        get = self.table.get
        return self.machine.decode(b"".join([get(i, b"") for i in ids]))

    def end(self) -> str:
        return self.machine.decode(b"", final=True)


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One transducer for each worker process and file."""
    return Transducer(path)


def ids_of(t: Transducer, text: str | None) -> tuple[int, list[int], str]:
    ids = array("I", t.encode(text)).tolist()
    return len(ids), ids, t.decode(ids)


def digest_of(t: Transducer, text: str | None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids and of the decoded text, in constant memory."""
    n, ids, decoded, machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(t)
    for block in t.encode_stream(text):
        ids.update(block)
        n += len(block) // 4
        decoded.update(machine.feed(array("I", block)).encode())
    decoded.update(machine.end().encode())
    return n, ids.hexdigest(), decoded.hexdigest()


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode every text, then decode the ids.

    Returns ``id_col, ids array<int>, decoded`` or, with ``digests``, the SHA-256 of both in place of
    them. ``vocabulary`` is a path that every executor can open. A narrow map: no shuffle, so each row
    is recomputed alone if its executor is lost.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches):
        t = transducer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(digest_of if digests else ids_of)(t, text) for text in part.column(1).to_pylist()]
                counts, first, second = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())], names=[id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
