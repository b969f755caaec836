"""Exact top-k by integer inner product with the threshold algorithm.

Candidates are dealt into blocks and queries into blocks; a task takes one block of each. It sorts the
candidates' components into one list per dimension, and their lengths into one more, and reads the lists of each query
from their best end, a stretch at a time: first the half of the lists in which the bound drops most. A candidate met in
any list gets its whole score at once. Candidates not met yet have no better component than the next entry of each list
and are no longer than the next entry of the lengths; the best score that such a vector could have bounds them all. The
task stops when that bound is below the k-th score found, or when every candidate has been met. The blocks' best k are
then merged by rank.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part; vectors of different
lengths score over the components both have; ties go to the smaller id; repeated vectors are candidates like
others, and only a query's own id is left out; fewer than k candidates give fewer rows; an empty vector scores 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of candidates and of queries, on average.
CANDIDATES, QUERIES = 4096, 8192
#: Entries first read from a list; each time it is read again, as many as before in all.
STRETCH = 64


def whole(vectors: DataFrame, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & ~bad)


def best_left(weights: np.ndarray, ceilings: np.ndarray, length: float) -> float:
    """Largest inner product with ``weights`` (all positive) of a vector that is nowhere above ``ceilings`` and not longer
    than ``length``: the ceilings where they are low for their weight, elsewhere in proportion to the weights."""
    low = ceilings <= 0
    score, energy = float(weights[low] @ ceilings[low]), length * length - float(ceilings[low] @ ceilings[low])
    if energy < 0:
        return -np.inf
    w, t = weights[~low], ceilings[~low]
    order = np.argsort(t / w)
    w, t = w[order], t[order]
    used = np.concatenate([[0.0], np.cumsum(t * t)])
    rest = np.concatenate([np.cumsum((w * w)[::-1])[::-1], [0.0]])
    # with the first i at their ceilings, the others may go up to the i-th ceiling's share of their weights
    needed = used[:-1] + (t / w) ** 2 * rest[:-1]
    i = int(np.searchsorted(needed, energy, side="right"))
    return score + float(w[:i] @ t[:i]) + float(np.sqrt(max(0.0, energy - used[i]) * rest[i]))


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, items: np.ndarray, ids: np.ndarray):
        # whole numbers below 2**53 have exact sums and products in double precision, where products are faster
        small = np.abs(items.astype(np.float64)).max(initial=0) < 2**26
        self.items, self.ids, self.small = items.astype(np.float64) if small else items, ids, small
        self.order = np.argsort(items, axis=0, kind="stable")  # per dimension, rising
        self.values = np.take_along_axis(items, self.order, axis=0)
        lengths = np.sqrt((items.astype(np.float64) ** 2).sum(axis=1))
        self.by_length = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.by_length]

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """``(id, score)`` of the query's k best, and how many candidates were met."""
        items, ids, n = self.items, self.ids, len(self.items)
        if self.small and np.abs(query).max(initial=0) < 2**26 / max(1, len(query)):
            query = query.astype(np.float64)
        elif self.small:
            items = items.astype(np.int64)
        dims = np.flatnonzero(query)
        q = query[dims]
        weights = np.abs(q).astype(np.float64)
        depth = np.zeros(len(dims) + 1, np.int64)  # of each list, and of the lengths
        met, scores, count, kth = np.zeros(n, bool), np.zeros(n, np.int64), 0, -np.inf

        def entry(at: np.ndarray) -> np.ndarray:
            """What the lists have at these depths, with the sign of the query's component."""
            at = np.minimum(at, n - 1)
            return np.where(q > 0, self.values[n - 1 - at, dims], -self.values[at, dims]).astype(np.float64)

        while count < n:
            step = np.maximum(STRETCH, depth)
            here = entry(depth[:-1])
            drop = weights * (here - entry(depth[:-1] + step[:-1]))
            chosen = np.argsort(-drop, kind="stable")[: (len(dims) + 1) // 2]
            rows = [self.order[n - depth[d] - step[d] if depth[d] + step[d] < n else 0 : n - depth[d], dims[d]] if q[d] > 0 else self.order[depth[d] : depth[d] + step[d], dims[d]] for d in chosen.tolist()]
            rows.append(self.by_length[depth[-1] : depth[-1] + step[-1]])
            depth[chosen] += step[chosen]
            depth[-1] += step[-1]
            fresh = np.zeros(n, bool)
            fresh[np.concatenate(rows)] = True
            fresh = np.flatnonzero(fresh & ~met)
            met[fresh] = True
            count += len(fresh)
            scores[fresh] = items[fresh] @ query
            found = np.flatnonzero(met)
            found = found[ids[found] != own]
            if len(found) >= k:
                kth = np.partition(scores[found], len(found) - k)[len(found) - k]
            if (depth >= n).any():
                break  # a list read to its end has met them all
            if best_left(weights, entry(depth[:-1]), float(self.lengths[depth[-1]])) < kth - 1e-6 * (1 + abs(kth)):
                break
        found = np.flatnonzero(met & (ids != own))
        if len(found) > k:  # all that reach the k-th score, so that ties are settled by id
            found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((ids[found], -scores[found]))][:k]
        return [(int(ids[i]), int(scores[i])) for i in found], count


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best candidates other than itself by the inner
    product of ``floor(scale * x)``."""
    integers = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    q, c = (whole(x, vector_col).select(F.col(id_col).cast("long").alias("id"), integers.alias("v")) for x in (queries, candidates))
    parts = max(1, -(-c.count() // CANDIDATES))
    chunks = max(1, -(-q.count() // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("cb", every(parts))
    c = c.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("qb", every(chunks))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        dims = max(max(map(len, left["v"])), max(map(len, right["v"])))
        square = lambda vs: np.stack([np.pad(np.asarray(v, np.int64), (0, dims - len(v))) for v in vs])
        lists = Lists(square(right["v"]), right["id"].to_numpy())
        best = [(own, *found) for own, q in zip(left["id"].tolist(), square(left["v"])) for found in lists.best(q, own, k)[0]]
        return pd.DataFrame(best, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(run, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
