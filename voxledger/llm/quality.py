"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel over standardised statistics of a text. Each task adds up its
own rows' part of the normal equations, Spark adds the parts, and one system of as many unknowns as there
are features is solved on the driver. Scores are made probabilities by isotonic regression on a grid of
scores, whose counts Spark adds up too. All that reaches the driver has a size set by parameters.

Edge cases: null text is the empty text, which has statistics of its own; unlabelled rows are scored like
others; without any labelled row every score is 0.5; repeated labels of a document count once.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

STATISTICS = ("chars", "words", "lines", "word_mean", "line_mean", "upper", "digit", "punct", "symbol", "blank", "pipe", "mark_words", "distinct_words", "distinct_lines", "top_word", "stop_marks", "long_words", "caps_words", "other")
GRID = 2000


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, in the order of STATISTICS."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    by = np.bincount(raw, minlength=256)
    words, lines = text.split(), text.split("\n")
    k = max(1, len(words))
    kinds = Counter(words)
    upper, digit = by[65:91].sum(), by[48:58].sum()
    punct = by[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    symbol = by[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]].sum()
    marked = sum(not w[-1].isalnum() and w[-1] not in ",.;:?" for w in kinds)
    caps = sum(w.isupper() and len(w) > 1 for w in kinds)
    top = max(kinds.values(), default=0)
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), len(text) / k, math.log1p(len(words) / len(lines)),
        upper / n, digit / n, punct / n, symbol / n, by[32] / n, by[124] / n, marked / max(1, len(kinds)), len(kinds) / k, len(set(lines)) / len(lines),
        top / k, by[[46, 33, 63]].sum() / k, sum(len(w) > 15 for w in kinds) / max(1, len(kinds)), caps / max(1, len(kinds)), by[128:].sum() / n,
    ]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its texts, and a column of that name if there is one, replaced by ``stats array<double>``: a narrow
    map."""
    keep = [c for c in docs.columns if c not in (text_col, "stats")]

    def run(batches):
        for batch in batches:
            stats = pa.array([statistics(t) for t in batch.column(len(keep)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], stats], names=[*keep, "stats"])

    schema = docs.select(*keep).schema.add("stats", ArrayType(DoubleType()))
    return docs.select(*keep, text_col).mapInArrow(run, schema)


class Model:
    """Standardisation, random frequencies, ridge weights and the calibration curve."""

    def __init__(self, mean, scale, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.frequencies = rng.normal(0, 1 / width, (len(mean), features))
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.curve: tuple[list[float], list[float]] = ([0.0], [0.5])

    def features(self, stats):
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.frequencies + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats):
        return self.features(stats) @ self.weights

    def score(self, stats):
        return np.clip(np.interp(self.raw(stats), *self.curve), 0, 1)


def isotonic(x: list[float], y: list[float], w: list[float]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators over points in the order of ``x``; block means and weighted values."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]


def fit(labelled: DataFrame, label_col: str, features: int = 200, width: float = 4.0, ridge: float = 1e-3, seed: int = 11) -> Model:
    """Fit on ``labelled(stats, label_col)``, all of it: the sums grow with the features, not the rows."""
    rows = labelled.where(F.col(label_col).isNotNull()).select("stats", F.col(label_col).cast("double").alias("y"))
    moments = rows.select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not moments:
        return Model([0.0] * len(STATISTICS), [1.0] * len(STATISTICS), features, width, seed)
    model = Model([r["m"] for r in moments], [r["s"] or 1.0 for r in moments], features, width, seed)

    def sums(batches):
        total, n = None, 0
        for b in batches:
            z = model.features(np.stack(b["stats"].to_numpy()))
            part = z.T @ np.hstack([z, b["y"].to_numpy()[:, None]])
            total, n = part if total is None else total + part, n + len(b)
        if total is not None:
            yield pd.DataFrame({"row": np.arange(len(total)), "sums": list(total), "n": n})

    parts = rows.mapInPandas(sums, "row int, sums array<double>, n long").select("row", "n", F.posexplode("sums").alias("col", "v"))
    solved = parts.groupBy("row", "col").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    size = features + 1
    system = np.zeros((size, size + 1))
    system[solved["row"], solved["col"]] = solved["v"]
    count = float(solved["n"].iloc[0])
    model.weights = np.linalg.solve(system[:, :size] + ridge * count / size * np.eye(size), system[:, size])

    def bins(batches):
        for b in batches:
            raw = model.raw(np.stack(b["stats"].to_numpy()))
            yield pd.DataFrame({"bin": np.floor(np.clip(raw, -1, 2) * GRID / 3).astype(int), "raw": raw, "y": b["y"]}).groupby("bin", as_index=False).agg(x=("raw", "sum"), y=("y", "sum"), n=("raw", "size"))

    curve = rows.mapInPandas(bins, "bin long, x double, y double, n long").groupBy("bin").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("n").alias("n")).orderBy("bin").toPandas()
    model.curve = isotonic([*curve["x"] / curve["n"]], [*curve["y"] / curve["n"]], [*curve["n"].astype(float)])
    return model


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` to ``rows(stats)``."""

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(stats.to_numpy()))) if len(stats) else pd.Series([], dtype=float)

    return rows.withColumn("score", score("stats"))
