"""Text kernel as built-in column expressions: normalising, stemming, token and trigram sets, lexical similarity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content, degree words, contractions in order, idioms that mean "works well",
# suffixes in order, and product-name endings.
STOPWORDS = [
    "a", "an", "the", "it", "its", "is", "are", "was", "were", "be", "been", "i", "my", "me", "we", "our", "you",
    "your", "this", "that", "these", "they", "them", "those", "she", "he", "her", "him", "his", "hers", "us", "to",
    "of", "for", "and", "or", "in", "on", "at", "with", "so", "very", "really", "just", "have", "has", "had", "do",
    "does", "did", "not", "will", "would", "gonna", "going", "am", "s", "re", "ll", "ve", "get", "gets", "got",
    "item", "items", "product", "products", "thing", "things", "stuff", "one", "ones", "also", "too", "as", "what",
]
INTENSIFIERS = [
    "very", "really", "so", "quite", "extremely", "pretty", "super", "surprisingly", "truly", "incredibly",
    "absolutely", "totally", "definitely", "certainly",
]
CONTRACTIONS = [("’", "'"), ("n't", " not"), ("'re", " are"), ("'ll", " will"), ("'ve", " have"), ("'m", " am"), ("'d", " would")]
IDIOMS = [
    (r"\b(do|does|did|doing|done|doin) the (trick|job)\b", "works well"),
    (r"\b(get|gets|got|getting) the job done\b", "works well"),
    (r"\bright tools? for the job\b", "works well"),
    (r"\bdoes (exactly )?what (it|they) (is |are |s )?(supposed|meant) to( do)?\b", "works well"),
    (r"\bquick fix\b", "fix"),
]
SUFFIXES = ["ing", "edly", "ied", "ies", "ed", "ly", "es", "s"]
#: Suffixes one of which ends every word that any suffix ends; most words end in none.
LEAST_SUFFIXES = [x for x in SUFFIXES if not any(x != y and x.endswith(y) for y in SUFFIXES)]
PRODUCT_ENDING = r"(?i)(?:[ _]+\+?[ _]*(?:pp?ositive|negative)\b)+$"


def _folded(text: Column) -> Column:
    """Compatibility decomposition and full case folding, by the Unicode library that Spark ships; a null fails, so it must
    not come here."""
    parts = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), parts, F.lit(True))


def normalize(text: Column) -> Column:
    """Compatibility decomposition, case folding, runs of other than word characters to one blank; so the marks of
    accented letters become blanks. ASCII texts, told by their length in bytes, need one pattern only, which is the class
    of its own that the JVM has for it, six times as fast as one spelt out; letters and numerals of others are those that
    the JVM's Unicode version knows."""
    wide = F.octet_length(text) > F.length(text)
    words = F.when(wide, F.regexp_replace(_folded(text), r"[^\p{L}\p{N}_]+", " ")).otherwise(F.regexp_replace(F.lower(text), r"\W+", " "))
    return F.trim(words)


def _contracted(text: Column) -> Column:
    out = F.lower(text)
    for short, long in CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(long))
    return normalize(out)


def prepare(text: Column) -> Column:
    """Normalised text with contractions written out and idioms replaced."""
    out = _contracted(text)
    for pattern, words in IDIOMS:
        out = F.regexp_replace(out, pattern, words)
    return out


def idiom_fired(text: Column) -> Column:
    return _contracted(text).rlike("|".join(f"(?:{pattern})" for pattern, _ in IDIOMS))


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def stem(token: Column) -> Column:
    """Strip the first suffix in order that leaves three letters, again and again; then a doubled last letter."""

    def once(t: Column, _: Column) -> Column:
        out = None
        for suffix in SUFFIXES:
            fits = t.endswith(suffix) & (F.length(t) - len(suffix) >= 3)
            cut = F.substring(t, F.lit(1), F.length(t) - len(suffix))
            out = F.when(fits, cut) if out is None else out.when(fits, cut)
        return out.otherwise(t)

    any_fits = reduce(or_, (token.endswith(x) for x in LEAST_SUFFIXES))
    stripped = F.when(any_fits, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(token) - 2, F.lit(1))), token, once)).otherwise(token)
    doubled = lambda t: F.when((F.length(t) > 3) & (F.substring(t, -1, 1) == F.substring(t, -2, 1)), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return _once(stripped, doubled)


#: Characters of two UTF-16 units.
TWO_UNITS = r"[\x{10000}-\x{10FFFF}]"


def _stems(prepared: Column, without: list[str]) -> Column:
    words = F.filter(F.split(prepared, " "), lambda w: (w != "") & ~w.isin(without))
    return F.array_distinct(F.transform(words, stem))


def tokens(prepared: Column) -> Column:
    return _stems(prepared, STOPWORDS)


def content_tokens(prepared: Column) -> Column:
    return _stems(prepared, STOPWORDS + INTENSIFIERS)


def trigrams(prepared: Column) -> Column:
    """Distinct trigrams of the padded text, in one pass; characters of two UTF-16 units need places counted in code points."""

    def grams(s: Column) -> Column:
        slow = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))
        quick = F.regexp_extract_all(s, F.lit(r"(?s)(?=(.{3}))"), F.lit(1))
        return F.when(F.length(s) > 2, F.array_distinct(F.when(s.rlike(TWO_UNITS), slow).otherwise(quick))).otherwise(_nothing())

    return _once(F.concat(F.lit(" "), prepared, F.lit(" ")), grams)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def similarity(a_tokens: Column, a_grams: Column, b_tokens: Column, b_grams: Column) -> Column:
    return 0.6 * jaccard(a_tokens, b_tokens) + 0.4 * jaccard(a_grams, b_grams)


def product_key(stem_: Column) -> Column:
    """A file's product: its stem without trailing sentiment words, or the stem if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(stem_, PRODUCT_ENDING, "")), F.lit("")), stem_)
