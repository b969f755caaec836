"""Toxicity: a learned lexicon held as a trie, met by Levenshtein automata, weighed by context.

Learning. On a bounded sample of labelled documents the words and the beginnings of their forms are counted by the
documents that have them; those much commoner in toxic documents become terms with their log-odds as
weight. A logistic regression on the sample then sets how far exact hits, misspelled hits and hits inside a
quotation each count.

Scoring. Each distinct word of a text is run as a Levenshtein automaton through the trie of terms: a
term is met by a word that starts with it and has at most REST letters more, or whose beginning is the term but for one
edit (two from nine letters on). A term of three to five letters is met with an edit only by a word in which a digit or
sign stands among the letters. Terms are cut into pieces of which one must be left whole by so few edits, so most words
never start the automaton. Each place of a hit is looked at in a window: between quotation marks it counts as
quoted.

Edge cases: null and empty texts have no hits and get the score of a text without any; repeated labels
of a document count once; without toxic labels, or without their documents, every score is 0; ties in the sample go by hash, then id.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and digits, with signs that stand for letters among them.
WORD = re.compile(r"[^\W_]+(?:[*@$!#]+[^\W_]+)*")
SIGNS = re.compile(r"[*@$!#]+")
QUOTES = re.compile("[\"“”„«»‹›]")
CACHE_ENTRIES = 300_000
#: Characters on either side of a hit that its context is read from.
WINDOW = 60
#: Letters of a term at least, of a word's beginning that is a term at least, and letters that may follow a term.
SHORTEST, STEM, REST = 3, 4, 4


def edits(length: int, disguised: bool = False) -> int:
    """Edits that a misspelled term of this length may have."""
    return int(disguised) if length < 6 else 1 if length < 9 else 2


def terms_of(word: str) -> list[str]:
    """The terms that a word may be met by: itself, and its beginnings that leave at most REST letters."""
    if not word.isalpha() or len(word) < SHORTEST:
        return []
    return [word[:n] for n in range(max(STEM, len(word) - REST), len(word))] + [word]


class Automaton:
    """Levenshtein automaton of one word: a state is a row of edit distances, cut off above ``k``."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> list[int]:
        return list(range(len(self.word) + 1))

    def step(self, state: list[int], c: str) -> list[int]:
        row = [state[0] + 1]
        for j, w in enumerate(self.word):
            row.append(min(row[j] + 1, state[j + 1] + 1, state[j] + (w != c)))
        return row


class Lexicon:
    """Terms and weights as a trie, with the pieces that a misspelled word must share with a term."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.trie: dict = {}
        self.pieces: dict[str, set[int]] = {}
        self.cache: dict[str, tuple[float, int] | None] = {}
        self.first = {t[:SHORTEST] for t in weights}
        for term in weights:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            if k := edits(len(term)):
                cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
                for a, b in zip(cuts, cuts[1:]):
                    self.pieces.setdefault(term[a:b], set()).update(range(max(0, a - k), a + k + 1))
        self.lengths = sorted({len(p) for p in self.pieces})
        self.longest = max(map(len, weights), default=0)

    def exact(self, word: str) -> float | None:
        """Weight of the best term that the word starts with and goes beyond by REST letters at most."""
        found = None
        if word[:SHORTEST] in self.first:
            node = self.trie
            for c in word:
                if (node := node.get(c)) is None:
                    break
                if (term := node.get("")) is not None and len(word) - len(term) <= REST and (found is None or self.weights[term] > found):
                    found = self.weights[term]
        return found

    def find(self, word: str) -> tuple[float, int] | None:
        """Weight of the best term that the word meets, and the edits between them. Of a word with signs in it each part
        counts, too; a word that is longer than the longest term with its edits and rest can't meet any."""
        if word in self.cache:
            return self.cache[word]
        letters = sum(map(str.isalpha, word))
        disguised = letters < len(word)
        weights = [w for part in (word, *(SIGNS.split(word) if disguised else ())) if (w := self.exact(part)) is not None]
        found = (max(weights), 0) if weights else None
        if found is None and len(word) <= self.longest + 2 + REST:
            if (letters >= SHORTEST and 3 * letters >= 2 * len(word)) if disguised else (len(word) >= 5 and self.near(word)):
                found = self.intersect(word, disguised)
        if len(self.cache) < CACHE_ENTRIES:
            self.cache[word] = found
        return found

    def near(self, word: str) -> bool:
        for n in self.lengths:
            for i in range(len(word) - n + 1):
                if (at := self.pieces.get(word[i : i + n])) is not None and i in at:
                    return True
        return False

    def intersect(self, word: str, disguised: bool = False) -> tuple[float, int] | None:
        """Walk the trie for as long as the word's automaton can still accept; it accepts in any state in which at most
        REST letters of the word are left."""
        automaton, best = Automaton(word, 2), None
        todo = [(self.trie, automaton.start())]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    d = min(state[-1 - REST :])
                    if 0 < d <= edits(len(child), disguised) and (best is None or (d, -self.weights[child]) < (best[1], -best[0])):
                        best = (self.weights[child], d)
                elif min(after := automaton.step(state, c)) <= automaton.k:
                    todo.append((child, after))
        return best


def quoted(text: str, start: int, end: int, window: int = WINDOW) -> bool:
    """Whether the place lies between quotation marks of its own line, within the window."""
    left, right = text[max(0, start - window) : start].rpartition("\n")[2], text[end : end + window].partition("\n")[0]
    return bool(QUOTES.search(left) and QUOTES.search(right)) and len(QUOTES.findall(left)) % 2 == 1


def hit_features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Summed weights of exact, misspelled and quoted hits (log1p), the largest exact weight, hits a word."""
    if not text:
        return [0.0] * 5
    low = text.lower()
    words = WORD.findall(low)
    met = {w: f for w in set(words) if (f := lexicon.find(w)) is not None}
    if not met:
        return [0.0] * 5
    exact = near = cited = top = 0.0
    for m in WORD.finditer(low):
        if (f := met.get(m[0])) is not None:
            if quoted(low, m.start(), m.end()):
                cited += f[0]
            elif f[1]:
                near += f[0] / (1 + f[1])
            else:
                exact += f[0]
                top = max(top, f[0])
    return [float(np.log1p(exact)), float(np.log1p(near)), float(np.log1p(cited)), top, 100 * (exact + near) / len(words)]


class Model:
    def __init__(self, weights: dict[str, float], coefficients: list[float]):
        self.weights, self.coefficients = weights, coefficients

    def score(self, features) -> np.ndarray:
        x = np.asarray(features, float).reshape(-1, len(self.coefficients) - 1)
        z = np.clip(x @ np.asarray(self.coefficients[1:]) + self.coefficients[0], -35, 35)
        return 1 / (1 + np.exp(-z))


def sample(labels: DataFrame, label_col: str, each: int) -> DataFrame:
    """At most ``each`` labelled ids of either class, by hash: a bounded table."""
    one = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    pick = lambda y: one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    return pick(1).unionByName(pick(0))


def term_counts(rows: DataFrame) -> DataFrame:
    """``term, pos, neg``: documents of either class that have a word or word beginning, counted within tasks
    first."""

    def run(batches):
        for b in batches:
            pos, neg = Counter(), Counter()
            for text, y in zip(b["text"], b["y"]):
                words = set(WORD.findall((text or "").lower()))
                terms = {t for w in words for t in terms_of(w)}
                (pos if y else neg).update(terms)
            terms = list({**pos, **neg})
            yield pd.DataFrame({"term": terms, "pos": [pos[t] for t in terms], "neg": [neg[t] for t in terms]})

    return rows.mapInPandas(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def terms_met(text: str, terms: set[str]) -> dict[str, str]:
    """The given terms that words of the text start with, each with the neighbours of its first word."""
    words, out = WORD.findall(text.lower()), {}
    for i, w in enumerate(words):
        for t in terms_of(w):
            if t in terms and t not in out:
                out[t] = " ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2])
    return out


def choose_terms(documents: list[tuple[int, dict[str, str]]], odds: dict[str, float], least_gain: float, cost: float = 3.0, times: int = 3, least_spread: float = 0.25) -> dict[str, float]:
    """Terms that cover the toxic documents up to ``times`` each, chosen by what they add.

    ``documents`` are (label, telling terms with their neighbours). Words of a copied text stand between the same
    neighbours wherever they occur, so a term needs different neighbours in ``least_spread`` of its toxic
    documents. A term gains the toxic documents that are not covered enough yet and pays ``cost`` for
    each other document.
    """
    having: dict[str, set[int]] = {}
    around: dict[str, set[str]] = {}
    price: Counter = Counter()
    for i, (y, terms) in enumerate(documents):
        for t, beside in terms.items():
            if y:
                having.setdefault(t, set()).add(i)
                around.setdefault(t, set()).add(beside)
            else:
                price[t] += 1
    having = {t: have for t, have in having.items() if len(around[t]) >= max(least_gain, least_spread * len(have))}
    out: dict[str, float] = {}
    covered: Counter = Counter()
    while having:
        gains = {t: len(have) - cost * price[t] for t, have in having.items()}
        best = max(gains, key=lambda t: (gains[t], len(t), t))
        if gains[best] < least_gain:
            break
        out[best] = odds[best]
        won = having.pop(best)
        covered.update(won)
        done = {i for i in won if covered[i] >= times}
        # what a chosen beginning starts is met by it already
        having = {t: rest for t, have in having.items() if not (t.startswith(best) and len(t) - len(best) <= REST) and (rest := have - done)}
    return out


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", each: int = 6000, least_docs: int = 4, least_share: float = 0.01, least_odds: float = 1.5, most_terms: int = 2000) -> Model:
    """Fit on at most ``each`` labelled documents of either class and ``most_terms`` terms.

    A term is in at least ``least_docs`` documents and ``least_share`` of the toxic ones, so that a copied text
    makes none of its words a term, and its log-odds less 1.64 standard errors are ``least_odds`` or more.
    """
    chosen = sample(labels, label_col, each)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    totals = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    positives, negatives = totals.get(1, 0), totals.get(0, 0)
    if not positives:
        return Model({}, [-35.0, 0, 0, 0, 0, 0])
    ratio = F.log((F.col("pos") + 0.5) / (positives + 1.0)) - F.log((F.col("neg") + 0.5) / (negatives + 1.0))
    sure = ratio - 1.64 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    telling = term_counts(rows).where((F.col("pos") >= max(least_docs, least_share * positives)) & (sure >= least_odds)).orderBy(F.desc(F.col("pos") * ratio), "term").limit(most_terms)
    odds = {t: float(np.log((p + 0.5) / (positives + 1)) - np.log((n + 0.5) / (negatives + 1))) for t, p, n in telling.collect()}

    known = set(odds)

    def incidence(batches):
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "terms": [terms_met(t, known) for t in b["text"]]})

    met = rows.mapInPandas(incidence, "y int, terms map<string,string>")
    weights = choose_terms([(r["y"], r["terms"]) for r in met.collect()], odds, max(3, least_share * positives / 4))

    def features(batches):
        lexicon = Lexicon(weights)
        for b in batches:
            yield pd.DataFrame({"x": [hit_features(t, lexicon) for t in b["text"]], "y": b["y"].astype(float)})

    seen = rows.select("text", "y").mapInPandas(features, "x array<double>, y double").toPandas()
    if not len(seen):
        return Model({}, [-35.0, 0, 0, 0, 0, 0])
    x, y = np.hstack([np.ones((len(seen), 1)), np.stack(seen["x"].to_numpy())]), seen["y"].to_numpy()
    beta = np.zeros(x.shape[1])
    damp = 0.05 * np.eye(len(beta))
    for _ in range(40):  # Newton steps of a ridge-damped logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, x.T @ (y - p) - damp @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Model(weights, beta.tolist())


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score`` to ``docs``: a narrow map over whole texts."""
    weights = tuple(sorted(model.weights.items()))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        lexicon = lexicon_of(weights)
        return pd.Series(model.score([hit_features(t, lexicon) for t in texts]) if len(texts) else [], dtype=float)

    return docs.withColumn("score", score(text_col))


_LEXICONS: dict[tuple, Lexicon] = {}


def lexicon_of(weights: tuple) -> Lexicon:
    """One lexicon, with its cache, for each worker process and model."""
    if weights not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[weights] = Lexicon(dict(weights))
    return _LEXICONS[weights]
