"""Secret scan by assignment-aware lexing.

A text is read as source or configuration: at every assignment sign (``=``, ``:=``, ``=>``, ``:``; comparisons are
none) the lexer takes the name before it, across a type if one is declared, and the literal after it (on one line or
several, put together with plus signs, or an indented block) or the other name; an element's text goes by its name. Names are then followed to the literals that they stand for: the latest definition before
the place, or else the first after it. A literal is scored by how sensitive its
target's name is and by how random it looks; those above the threshold are ``lexed`` spans. The
fixed base patterns (assignments to password-like names, cloud access ids, long hexadecimal strings)
are always reported as they match.

Edge cases: null text is empty; an empty text has no spans; overlapping kinds are each reported and
merged only when text is redacted. The scan is a narrow map over whole texts.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "lexed")
#: Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Assignment signs; comparisons are none.
SIGN = re.compile(r":=|=>|(?<![=!<>])=(?![=>~])|:")
NAME = re.compile(r"[A-Za-z_$][\w$.\-]*", re.A)
ONE_TYPE = r"(?:[&*?]|\[\d*\]|'static[ \t]+)*[A-Za-z_][\w.]*(?:::[\w.]+)*(?:\[[^\[\]\n=]*(?:\[[^\[\]\n=]*\][^\[\]\n=]*)*\]|<[^<>\n=]*(?:<[^<>\n=]*>[^<>\n=]*)*>)*+[?!]?"
TYPE = rf"{ONE_TYPE}(?:[ \t]*[|&][ \t]*{ONE_TYPE})*"
#: What follows the colon of a declaration, up to its sign; and declarations with the type after the name.
TYPED = re.compile(rf"[ \t]*{TYPE}[ \t]*=(?![=>])", re.A)
DECLARED = re.compile(rf"\b(?:var|const|let|static|val)[ \t]+([A-Za-z_$][\w$]*)[ \t]+{TYPE}[ \t]*=(?![=>])", re.A)
LITERAL = re.compile(
    r"""[ \t]*(?:(?:\\\r?\n[ \t]*|\(\s*)?(?:[rRbBuUfF]{1,2}(?=["']))?(?:\"{3}((?:[^\\]|\\.)*?)\"{3}|'{3}((?:[^\\]|\\.)*?)'{3}|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`)|([^\s"'`,;(){}\[\]<>&?]+))""",
    re.S,
)
BARE = 6
#: A further part of a literal that is put together with plus signs; a block under a name; an element with text.
PART = re.compile(r"""["'`][ \t]*\\?\n?[ \t]*\+[ \t]*\n?[ \t]*(?:"([^"\\\n]*)"|'([^'\\\n]*)'|`([^`]*)`)""")
BLOCK = re.compile(r"[ \t]*[|>][+-]?\d?[ \t]*\n")
ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*)(?:[ \t][^<>\n]*)?>([^<>]+)</\1")
#: A name and a value as attributes of one element; a value handed to a setter.
ATTRIBUTES = re.compile(r"""<[A-Za-z][^<>\n]{0,256}?\b(?:key|name)[ ]?=[ ]?["']([^"'\n]{1,128})["'][^<>\n]{0,256}?\bvalue[ ]?=[ ]?["']([^"'\n]+)["']""")
SETTER = re.compile(r"""\bset_?([A-Z]\w{0,127}|(?<=_)[a-z]\w{0,127})\([ ]?["']([^"'\n]+)["'][ ]?\)""", re.A)
#: Characters that a type, or a literal or block inside another one, may have: so the scan takes linear time.
TYPE_LENGTH, NESTED_LENGTH = 128, 1024
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 2.5, "pass": 2.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "key": 1.2, "credential": 2.5, "auth": 1.5, "private": 1.5, "access": 1.0, "signature": 1.5, "salt": 1.5, "bearer": 2.5}
HARMLESS = {"public": 2.0, "example": 2.0, "test": 0.5, "primary": 1.5, "foreign": 1.5, "path": 1.0, "url": 1.0, "name": 1.0, "length": 1.5, "count": 1.5, "type": 1.0}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|undefined|changeme|your[-_ ]?\w*|example\w*|\$\{?.*|<.*|%.*|\{\{.*)$")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each fixed pattern, in code points, ends exclusive."""
    out: list[Span] = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [Span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [Span("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    """How sensitive a target's name is, from the parts that it is made of."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)
    low = [p.lower() for p in parts]
    joined = "".join(low)
    score = max([SENSITIVE.get(p, 0.0) for p in low] + [v for k, v in SENSITIVE.items() if v >= 2.5 and k in joined], default=0.0)
    return score - max((HARMLESS.get(p, 0.0) for p in low), default=0.0)


def literal_score(value: str) -> float:
    """How random a literal looks: bits a character, kinds of characters, length."""
    if len(value) < 6 or PLACEHOLDER.match(value):
        return -5.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return 0.5 * bits + 0.4 * kinds + min(n, 40) / 40 - 1.5 * (" " in value) - 1.0 * (kinds == 1)


def lexed_spans(text: str, threshold: float = 4.0) -> list[Span]:
    """Literals whose target, directly or through constants, is named like a secret."""
    if "=" not in text and ":" not in text and "</" not in text and "set" not in text:
        return []
    ends = {m.end(): m[0] for m in NAME.finditer(text)}
    declared = {m.end() - 1: m[1] for m in DECLARED.finditer(text)}
    found: list[tuple[set[str], str, int, int, bool]] = [({m[1]}, m[2].strip(), *trimmed(text, m.start(2), m.end(2)), False) for m in ELEMENT.finditer(text)] if "</" in text else []
    for pattern, sign in ((ATTRIBUTES, "<"), (SETTER, "set")):
        found += [({m[1]}, m[2].strip(), *trimmed(text, m.start(2), m.end(2)), False) for m in pattern.finditer(text)] if sign in text else []
    covered = in_block = 0
    for sign in SIGN.finditer(text):
        at = sign.start()
        name = name_before(text, at, ends)
        if name is not None and sign[0] == ":" and (typed := TYPED.match(text, sign.end(), sign.end() + TYPE_LENGTH)):
            declared[typed.end() - 1] = name
        names = {x for x in (name, declared.get(at)) if x is not None}
        if not names:
            continue
        if sign[0] == ":" and (block := BLOCK.match(text, sign.end())):
            line = text.rfind("\n", 0, at) + 1
            lines = deeper(len(text[line:at]) - len(text[line:at].lstrip(" \t"))).match(text, block.end(), len(text) if at >= in_block else block.end() + NESTED_LENGTH)
            if lines is not None:
                in_block = max(in_block, lines.end())
                start, end = trimmed(text, lines.start(), lines.end())
                found.append((names, text[start:end], start, end, False))
                continue
        literal = LITERAL.match(text, sign.end(), len(text) if at >= covered else sign.end() + NESTED_LENGTH)
        if literal is None:
            continue
        which = literal.lastindex
        value, start, end = literal[which], literal.start(which), literal.end(which)
        if which == BARE:
            covered = max(covered, end)
            value = value.rstrip(".:")
            end = start + len(value)
        else:
            parts = [value]
            while part := PART.match(text, end):
                parts.append(part[part.lastindex])
                end = part.end(part.lastindex)
            value = "".join(parts)
        if value:
            found.append((names, value, start, end, which == BARE))
    found.sort(key=lambda x: x[2])
    out: dict[tuple[int, int], Span] = {}
    for (names, *_), (value, start, end) in zip(found, resolved(found)):
        if (sensitive := max(map(name_score, names))) > 0.9 and sensitive + literal_score(value) >= threshold:
            out[start, end] = Span("lexed", start, end)
    return list(out.values())


@lru_cache(maxsize=256)
def deeper(indent: int) -> re.Pattern:
    """Lines that are indented by more than ``indent`` blanks."""
    return re.compile(rf"(?:[ \t]{{{indent + 1},}}[^\n]*\n?)+")


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The place without white space at its ends."""
    part = text[start:end]
    return start + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())


def name_before(text: str, at: int, ends: dict[int, str]) -> str | None:
    """The name that ends before ``at``, but for blanks and one closing mark."""
    while at and text[at - 1] in " \t":
        at -= 1
    if at and text[at - 1] in "\"'])":
        at -= 1
    elif at and text[at - 1] in "?!" and at - 1 in ends:  # an optional member
        at -= 1
    return ends.get(at)


def resolved(found: list[tuple[set[str], str, int, int, bool]]) -> list[tuple[str, int, int]]:
    """The literal that each assignment stands for, through names of constants defined anywhere in the text."""
    where: dict[str, list[int]] = {}
    for i, (names, *_) in enumerate(found):
        for x in {y for name in names for y in (name, name.rpartition(".")[2])}:
            where.setdefault(x, []).append(i)
    out: list[tuple[str, int, int] | None] = [None] * len(found)
    for first in range(len(found)):
        way, i = [], first
        while out[i] is None:
            _, value, start, end, bare = found[i]
            way.append(i)
            places = where.get(value, []) if bare else []
            k = bisect.bisect_left(places, i)
            later = k + (k < len(places) and places[k] == i)
            following = places[k - 1] if k else places[later] if later < len(places) else None
            out[i] = (value, start, end)
            if following is None:
                break
            i = following
        for j in way:
            out[j] = out[i]
    return out


def all_spans(text: str | None, threshold: float = 4.0) -> list[Span]:
    """Spans by start, then kind as listed in KINDS."""
    if not text:
        return []
    return sorted(base_spans(text) + lexed_spans(text, threshold), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redacted(text: str | None, spans: list[Span], mark: str = "[SECRET]") -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 4.0, digests: bool = False) -> DataFrame:
    """Per row its spans as ``array<struct<kind,start,end>>``; with ``digests`` counts by kind, the SHA-256
    of the base spans and all spans as text."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, " + ("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long" if digests else "spans array<struct<kind:string,start:int,end:int>>")

    def run(batches):
        for batch in batches:
            found = [all_spans(t, threshold) for t in batch.column(1).to_pylist()]
            if not digests:
                spans = pa.array([[s._asdict() for s in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=[id_col, "spans"])
                continue
            said = lambda x: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in x)
            n = {k: pa.array([sum(s.kind == k for s in x) for x in found], pa.int64()) for k in KINDS}
            base = pa.array([hashlib.sha256(said([s for s in x if s.kind != "lexed"]).encode()).hexdigest() for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), n["assign"], n["access"], n["hex"], base, pa.array([said(x) for x in found], pa.string()), n["lexed"]], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 4.0, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redacted(t, all_spans(t, threshold), mark), na_action="ignore")

    return docs.withColumn(text_col, clean(text_col))
