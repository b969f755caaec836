"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded with its code point. A letter
n-gram is the product of its letters' vectors, the k-th of them rotated by k places (binding keeps the
order). A text is the sum of its n-grams (bundling), a language the sum of its training texts, and a
text gets the language whose prototype has the largest cosine with it.

Training is a sum: each task bundles its rows by language, Spark adds the bundles up, and the prototypes
(languages x dimensions) are all that reaches the driver.

Edge cases: null text, and text without a letter, is ``und`` with score 0; a table without a learned
language predicts ``und``; ties go to the language that sorts first.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
GRAM = 3
#: n-gram vectors that a worker keeps (DIMENSIONS bytes each).
CACHE_ROWS = 60_000


class Profile:
    def __init__(self, dimensions: int, gram: int, seed: int):
        import numpy as np

        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.rows: dict[int, int] = {}
        self.table = np.empty((4096, dimensions), np.int8)
        self.letters: dict[int, object] = {}
        self.is_letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)

    def letter(self, code: int):
        import numpy as np

        if (v := self.letters.get(code)) is None:
            v = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
            v = self.letters[code] = v.astype(np.int8)
        return v

    def vector(self, gram: int):
        import numpy as np

        out = np.ones(self.dimensions, np.int8)
        for k in range(self.gram):
            out *= np.roll(self.letter(gram >> (21 * (self.gram - 1 - k)) & 0x1FFFFF), k)
        return out

    def grams(self, text: str):
        """Distinct n-grams over letters, with words apart, and their counts; None without a letter."""
        import numpy as np

        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        letter = self.is_letter[np.minimum(codes, 0xFFFF)]
        if (high := codes > 0xFFFF).any():
            distinct, at = np.unique(codes[high], return_inverse=True)
            letter[high] = np.array([chr(c).isalpha() for c in distinct.tolist()])[at]
        if not letter.any():
            return None
        codes = np.where(letter, codes, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of other characters one blank after a word
        codes = np.concatenate([[32], codes[keep], [32]])
        out = codes[: len(codes) - self.gram + 1].copy()
        for k in range(1, self.gram):
            out = out << 21 | codes[k : len(codes) - self.gram + 1 + k]
        return np.unique(out, return_counts=True)

    def bundle(self, text: str | None):
        """Sum of the text's n-gram vectors, or None."""
        import numpy as np

        if not text or (found := self.grams(text)) is None:
            return None
        grams, counts = found
        at, extra = np.empty(len(grams), np.int64), []
        for i, g in enumerate(grams.tolist()):
            if (row := self.rows.get(g)) is None:
                if (row := len(self.rows)) >= CACHE_ROWS:
                    extra.append(i)
                    row = 0
                else:
                    if row == len(self.table):
                        self.table = np.concatenate([self.table, np.empty_like(self.table)])
                    self.table[row] = self.vector(g)
                    self.rows[g] = row
            at[i] = row
        weight = counts.astype(np.float32)
        weight[extra] = 0
        out = np.zeros(self.dimensions, np.float64)
        for k in range(0, len(at), 2048):
            out += weight[k : k + 2048] @ self.table[at[k : k + 2048]].astype(np.float32)
        for i in extra:
            out += float(counts[i]) * self.vector(int(grams[i]))
        return out


@lru_cache(maxsize=2)
def profile(dimensions: int, gram: int, seed: int) -> Profile:
    return Profile(dimensions, gram, seed)


def train(docs: DataFrame, label_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = 7) -> dict[str, list[float]]:
    """Prototype of every label among ``docs``: bundles are added within tasks, then by Spark."""

    def run(batches):
        import numpy as np

        p, sums = profile(dimensions, gram, seed), {}
        for batch in batches:
            for label, text in zip(batch[label_col], batch[text_col]):
                if (v := p.bundle(text)) is not None:
                    if label not in sums:
                        sums[label] = np.zeros(dimensions)
                    sums[label] += v
        if sums:
            yield pd.DataFrame({"label": list(sums), "bundle": [v.tolist() for v in sums.values()]})

    rows = docs.where(F.col(label_col).isNotNull()).select(label_col, text_col).mapInPandas(run, "label string, bundle array<double>")
    by_place = rows.select("label", F.posexplode("bundle")).groupBy("label", "pos").agg(F.sum("col").alias("x"))
    return {r["label"]: [x["x"] for x in sorted(r["xs"], key=lambda x: x["pos"])] for r in by_place.groupBy("label").agg(F.collect_list(F.struct("pos", "x")).alias("xs")).collect()}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], text_col: str = "text", dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = 7) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the cosine, from 0 on) to ``docs``. A narrow map."""
    import numpy as np

    labels = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in labels]).reshape(len(labels), dimensions)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms == 0, 1, norms) if len(labels) else matrix

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        p, out = profile(dimensions, gram, seed), []
        for text in texts:
            v = p.bundle(text)
            if v is None or not len(labels) or not (size := float(np.sqrt(v @ v))):
                out.append(("und", 0.0))
                continue
            cosines = matrix @ v / size
            best = int(np.argmax(cosines))
            out.append((labels[best], float(min(1.0, max(0.0, cosines[best])))))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn("_guess", guess(text_col)).withColumns({"lang_pred": F.col("_guess.lang_pred"), "score": F.col("_guess.score")}).drop("_guess")
