"""Shared helpers of the training-data operators: reading, cutting lineage, hashing, components."""

from __future__ import annotations

import tempfile
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether the files of a query's shuffles are removed when the query has ended.
GIVEN_BACK = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The folder is the one the session names in ``spark.checkpoint.dir``; one of our own is set only
    where a session on a single machine names none, as in tests. What the plan shuffled is given back once the rows
    are written, since nothing can ask for it again.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    before = spark.conf.get(GIVEN_BACK, "false")
    spark.conf.set(GIVEN_BACK, "true")
    try:
        return df.select("*").checkpoint()  # a new plan: a plan keeps the setting that it was made under
    finally:
        spark.conf.set(GIVEN_BACK, before)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n: the rule by which rows are held out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)).cast("int")


def crc_mod_local(value: int, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(src, dst)``: one row ``(node, component)`` for each node
    that has an edge, ``component`` being the smallest node that it reaches.

    Distributed union-find by alternating large-star and small-star steps. Each round is two joins on
    the node, whose skew AQE splits; the edge set shrinks towards a star per component. Rounds end when
    the edge set stops changing (count and checksum, two numbers, are all that the driver sees).
    """
    pairs = cut(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        pairs = cut(small)
        now = pairs.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def hook(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Union-find of a task, in place: ``labels[i]`` is the least node known to be joined to i; joins each x with its y."""
    while (differ := labels[x] != labels[y]).any():
        x, y = x[differ], y[differ]
        a, b = labels[x], labels[y]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while ((up := labels[labels]) != labels).any():
            labels[:] = up
