"""The nearest vectors by cosine within a category, exactly, tile by tile.

Vectors of a category are put in order of their nearest pivot and their angle to it and cut into tiles; a tile knows the
range of its vectors' angles to every pivot. Two vectors are at least as far apart as their angles to any pivot differ, so
ranges that lie apart bound the cosines between two tiles. Each left tile first meets the right tile with the highest
bound; the k-th best that its vectors have found there is what another tile must be able to reach to be met at all.
Tiles meet in one task each, as one product of matrices, and at most k partners a vector leave it.

A zero vector counts as length 1 and is like nothing; vectors of one table have one length. On vectors spread evenly over
many dimensions angles to pivots hardly differ and most tiles meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.operators.lineage import cut, placed

#: Vectors of a tile, and pivots.
TILE, PIVOTS = 1024, 16


def units(items: DataFrame, by: str) -> DataFrame:
    norm: Column = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    rows = items.where(F.col(by).isNotNull()).select(by, "id", F.transform("v", lambda x: x.cast("double")).alias("v")).withColumn("_n", norm)
    return rows.select(by, "id", F.transform("v", lambda x: x / F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_n"))).alias("v"))


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def tiled(items: DataFrame, by: str, pivots: np.ndarray, tile: int) -> DataFrame:
    """``items(by, id, v)`` with ``tile`` and ``angles`` to the pivots."""

    def measure(batches):
        for b in batches:
            angles = np.arccos(np.clip(rows_of(b.column(2)) @ pivots.T, -1, 1)) if b.num_rows else np.zeros((0, len(pivots)))
            near = angles.argmin(axis=1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(angles), pa.list_(pa.float64())), pa.array(near, pa.int32())], names=[by, "id", "v", "angles", "near"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    rows = items.mapInArrow(measure, f"{kinds}, angles array<double>, near int")
    at = placed(rows, (by,), [F.col("near"), F.element_at("angles", F.col("near") + 1), F.col("id")], "_n")
    return cut(at.select(by, "id", "v", "angles", F.floor((F.col("_n") - 1) / tile).alias("tile")))


def ranges(tiles: DataFrame, by: str, n: int, side: str) -> DataFrame:
    each = lambda f: F.array(*(f(F.get("angles", F.lit(j))) for j in range(n)))
    return tiles.groupBy(by, F.col("tile").alias(side)).agg(each(F.min).alias(f"{side}_lo"), each(F.max).alias(f"{side}_hi"))


def met(left: DataFrame, right: DataFrame, pairs: DataFrame, by: str, k: int, floor: float) -> DataFrame:
    """``lt, l, r, sim``: the k nearest of each left vector in each right tile that its tile meets."""
    kind = {f.name: f.dataType.simpleString() for f in left.schema}
    a = left.withColumnRenamed("tile", "lt").join(pairs, [by, "lt"]).select(by, "lt", "rt", "id", "v", "_without")
    b = right.withColumnRenamed("tile", "rt").join(pairs, [by, "rt"]).select(by, "lt", "rt", "id", "v")

    def nearest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            y = y.sort_values("id")
            u, v, ids = np.stack(x["v"]), np.stack(y["v"]), y["id"].to_numpy()
            sims = u @ v.T
            for i, (own, without) in enumerate(zip(x["id"], x["_without"])):
                fit = np.flatnonzero(sims[i] >= floor - 1e-9)
                fit = fit[(ids[fit] != own) & ~np.isin(ids[fit], [] if without is None else without)]
                if len(fit) > k:  # all that may be among the k nearest, then exactly, alike vectors alike
                    fit = fit[sims[i][fit] >= np.partition(sims[i][fit], -k)[-k] - 1e-9]
                exact = (v[fit] * u[i]).sum(axis=1)
                fit, exact = fit[exact >= floor], exact[exact >= floor]
                out += [(x["lt"].iloc[0], own, ids[fit[j]], exact[j]) for j in np.lexsort((ids[fit], -exact))[:k]]
        return pd.DataFrame(out, columns=["lt", "l", "r", "sim"])

    return a.groupBy(by, "lt", "rt").cogroup(b.groupBy(by, "lt", "rt")).applyInPandas(nearest, f"lt long, l {kind['id']}, r {kind['id']}, sim double")


def cosine_shortlist(left: DataFrame, right: DataFrame, k: int = 3, floor: float = 0.35, by: str = "category", without: DataFrame | None = None, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """``l, r, rank`` of the k nearest of each left vector ``(id, by, v)`` by cosine at or above ``floor`` within ``by``, ties
    to the smaller id; pairs of ``without(l, r)``, which are few for each left vector, don't count."""
    a, b = units(left, by), units(right, by)
    chosen = [r["v"] for r in b.orderBy(F.xxhash64("id"), "id").select("v").limit(pivots).collect()]
    if not chosen:
        return left.select(F.col("id").alias("l"), F.col("id").alias("r"), F.lit(1).alias("rank")).limit(0)
    at, n = np.array(chosen), len(chosen)
    tb = tiled(b, by, at, tile)
    ta = tiled(a, by, at, tile).join(F.broadcast(ranges(tb, by, n, "rt").select(by).distinct()), by)
    if without is None:
        ta = ta.withColumn("_without", F.array().cast(f"array<{left.schema['id'].dataType.simpleString()}>"))
    else:
        ta = ta.join(without.groupBy(F.col("l").alias("id")).agg(F.collect_set("r").alias("_without")), "id", "left")
    la, rb = ranges(ta, by, n, "lt"), ranges(tb, by, n, "rt")
    apart = F.greatest(F.lit(0.0), *(F.greatest(F.col("rt_lo")[j] - F.col("lt_hi")[j], F.col("lt_lo")[j] - F.col("rt_hi")[j]) for j in range(n)))
    bounds = cut(la.join(rb, by).select(by, "lt", "rt", F.cos(apart).alias("bound")).where(F.col("bound") >= floor - 1e-9))
    first = bounds.withColumn("_p", F.row_number().over(Window.partitionBy(by, "lt").orderBy(F.desc("bound"), "rt"))).where("_p = 1").drop("_p")
    found = cut(met(ta, tb, first, by, k, floor))
    # what every vector of a left tile has found: its k-th best, or less than k
    kth = found.groupBy("l").agg(F.count("*").alias("n"), F.min("sim").alias("s"))
    reach = ta.select(by, F.col("tile").alias("lt"), "id").join(kth, F.col("id") == F.col("l"), "left").groupBy(by, "lt").agg(F.min(F.when(F.col("n") >= k, F.col("s")).otherwise(floor)).alias("reach"))
    others = bounds.join(first.select(by, "lt", F.col("rt").alias("_f")), [by, "lt"]).where("rt <> _f").join(reach, [by, "lt"]).where(F.col("bound") >= F.col("reach") - 1e-9)
    rest = met(ta, tb, others.select(by, "lt", "rt"), by, k, floor)
    ranked = found.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("sim"), "r")))
    return ranked.where(F.col("rank") <= k).select("l", "r", "rank")
