"""Near-duplicate join of vectors by cosine: a subspace pigeonhole join.

On unit vectors, cosine >= c is squared distance <= 2 - 2c. A random rotation spreads that distance over all
dimensions, which are then split into blocks; in at least one block a pair that is near has no more than the
block's share of the budget. So each block is range-joined under its share alone, and what a block finds is
verified with whole vectors in double precision.

A block's range join cuts its first coordinate (after a random rotation no axis is special) into cells as wide as the
block's radius: partners are in the same cell or the next. Cells are dealt out in chunks of bounded size, and pairs of
chunks are the tasks. A pair that several blocks find belongs to the one that it is nearest in for its budget, and
is counted there only. What leaves a task is a count of links for each vector and one edge for each vector that the
task joins to another, so a dense group makes no more rows than it has members in the task.

Equal vectors are joined once for all, so a group of exact copies costs one vector.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing and
are rows of their own; vectors of different lengths never link; ties go to the smallest id; rows that repeat an id are
vectors of their own if their vectors differ, and copies if not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.common import components, cut, hook

#: Vectors in a chunk of a cell, on average, and rows of a tile of pairs.
CHUNK, TILE = 32_000, 256
#: Slack for the single precision of the coordinates that blocks are joined by.
SLACK = 1e-5


def rotation(dims: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def subspaces(dims: int, blocks: int) -> list[slice]:
    cuts = [dims * i // blocks for i in range(min(blocks, dims) + 1)] if dims >= blocks else list(range(dims + 1))
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).to_numpy(zero_copy_only=False).reshape(-1, dims)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by the largest component first, so that no square overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def tile_links(one, two, k: int, parts: list[slice], budget: float, cosine: float, first: int, same: bool):
    """Index pairs ``x, y`` of linked vectors between a tile and a chunk, both ``(unit, turned)``, that block k finds, and
    whether each belongs to this block."""
    (a, p), (b, q) = one, two
    dims = a.shape[1]
    share = [budget * (s.stop - s.start) / dims + SLACK for s in parts]
    pk, qk = p[:, parts[k]], q[:, parts[k]]
    close = (pk * pk).sum(axis=1)[:, None] + (qk * qk).sum(axis=1)[None, :] - 2 * (pk @ qk.T) <= share[k] + SLACK
    if same:  # each pair once
        close &= np.arange(first, first + len(a))[:, None] < np.arange(len(b))[None, :]
    xs, ys = np.nonzero(close)
    out = []
    for at in range(0, len(xs), 1 << 16):
        x, y = xs[at : at + (1 << 16)], ys[at : at + (1 << 16)]
        near = (a[x] * b[y]).sum(axis=1) >= cosine
        x, y = x[near], y[near]
        apart = np.stack([((p[x, s] - q[y, s]).astype(np.float64) ** 2).sum(axis=1) / t for s, t in zip(parts, share)])
        out.append((x, y, apart.argmin(axis=0) == k))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]


def block_links(units: DataFrame, cosine: float, blocks: int, seed: int) -> DataFrame:
    """Over ``units(c, copies, dims, v)``: rows ``src, null, n`` with counts of links, and ``src, dst, 0`` with edges that
    keep what is linked together."""
    budget = 2 - 2 * cosine
    kind = units.schema["v"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for dims, rows in frame.groupby("dims"):
                dims = int(dims)
                turned = (unit(np.stack(rows["v"].to_numpy())) @ rotation(dims, seed)).astype(np.float32)
                cells = [np.floor(turned[:, s.start] / (np.sqrt(budget * (s.stop - s.start) / dims) * (1 + 1e-4) + 1e-6)).astype(int) for s in subspaces(dims, blocks)]
                yield pa.RecordBatch.from_pandas(rows[["c", "copies", "dims", "v"]].assign(r=list(turned), cells=list(np.stack(cells, axis=1))), schema=target, preserve_index=False)

    value = pa.float32() if kind == "array<float>" else pa.float64()
    target = pa.schema([("c", pa.int64()), ("copies", pa.int64()), ("dims", pa.int32()), ("v", pa.list_(value)), ("r", pa.list_(pa.float32())), ("cells", pa.list_(pa.int32()))])
    turned = cut(units.select("c", "copies", "dims", "v").mapInArrow(project, f"c long, copies long, dims int, v {kind}, r array<float>, cells array<int>"))
    rows = turned.select("c", "copies", "dims", "v", "r", F.posexplode("cells").alias("block", "cell"))
    sizes = rows.groupBy("dims", "block", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    # each cell knows its own chunks and its neighbours': cells are few, as a coordinate is between -1 and 1
    beside = lambda name, d: sizes.select("dims", "block", (F.col("cell") + d).alias("cell"), F.col("chunks").alias(name))
    known = sizes.join(beside("next", -1), ["dims", "block", "cell"], "left").join(beside("before", 1), ["dims", "block", "cell"], "left").fillna(0, ["next", "before"])
    rows = rows.join(F.broadcast(known), ["dims", "block", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
    place = lambda cell, i, j, side: F.struct(cell.cast("int").alias("cell"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    x, cell, upto = F.col("chunk"), F.col("cell"), lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # a task is a chunk i (side 0) against chunk j of its cell (1, or 0 again where i = j) and chunk j of the next cell (2)
    mine = F.transform(F.filter(upto(F.greatest("chunks", "next")), lambda j: (j >= x) & (j < F.col("chunks")) | (j < F.col("next"))), lambda j: place(cell, x, j, 0))
    other = F.transform(upto(x), lambda i: place(cell, i, x, 1))
    down = F.transform(upto(F.col("before")), lambda i: place(cell - 1, i, x, 2))
    dealt = rows.withColumn("p", F.explode(F.concat(mine, other, down)))

    def join(key, table):
        dims, k, _, i, j = (x.as_py() for x in key)
        parts = subspaces(dims, blocks)
        side, c, copies = (table.column(x).to_numpy() for x in ("side", "c", "copies"))
        u, r = unit(matrix(table.column("v"), dims)), matrix(table.column("r"), dims)
        labels, counts = np.arange(len(c)), np.zeros(len(c), np.int64)
        one = np.flatnonzero(side == 0)
        for two, same in ((one if i == j else np.flatnonzero(side == 1), i == j), (np.flatnonzero(side == 2), False)):
            if not len(two):
                continue
            b = (u[two], r[two])
            for at in range(0, len(one), TILE):
                some = one[at : at + TILE]
                p, q, own = tile_links((u[some], r[some]), b, k, parts, budget, cosine, at, same)
                p, q = some[p], two[q]
                hook(labels, p, q)
                counts += np.bincount(p[own], copies[q[own]], len(c)).astype(np.int64) + np.bincount(q[own], copies[p[own]], len(c)).astype(np.int64)
        met, moved = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(c)))
        src = np.concatenate([c[met], c[moved]])
        dst = pa.array(np.concatenate([np.zeros(len(met), np.int64), c[labels[moved]]]), mask=np.arange(len(src)) < len(met))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": dst, "n": pa.array(np.concatenate([counts[met], np.zeros(len(moved), np.int64)]), pa.int64())})

    columns = ["dims", "block", F.col("p.cell").alias("cell"), F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("p.side").alias("side"), "c", "copies", "v", "r"]
    return dealt.select(*columns).groupBy("dims", "block", "cell", "i", "j").applyInArrow(join, "src long, dst long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, blocks: int = 4, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    usable = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    sound = raw.where(usable)
    # a class is a distinct vector, known by a hash of it
    classes = cut(sound.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("c", F.xxhash64("v")))
    found = cut(block_links(classes.select("c", "copies", F.size("v").alias("dims"), "v"), cosine, blocks, seed))
    counted = found.where("dst is null").groupBy(F.col("src").alias("c")).agg(F.sum("n").alias("others"))
    joined = components(found.where("dst is not null").select("src", "dst")).withColumnRenamed("node", "c")
    told = classes.join(counted, "c", "left").join(joined, "c", "left").withColumn("component", F.coalesce("component", "c"))
    told = cut(told.select("v", "least", "component", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(named, "component").select("v", "n_links", "component_id")
    alone = raw.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = sound.join(told, "v").select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
