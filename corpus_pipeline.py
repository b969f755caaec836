"""The corpus pipeline: five stages over ``documents``, each one operator of the library.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each but the last returns the columns of
``documents``. Null texts pass as empty ones; a table without rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.llm import line_dedup, ngram_join, packing, secret_scan, toxicity
from voxledger.llm.common import cut, read_table
from voxledger.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, does not reject."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model).where("score < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document, or line, has alike."""
    return line_dedup.dedup(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    gone = ngram_join.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("id"), F.col("version").alias("hash")).distinct()
    same = (docs["doc_id"] == gone["id"]) & (F.xxhash64(docs["text"]) == gone["hash"])
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose secrets are replaced by a mark."""
    before = "_".join(["before", *docs.columns])  # a name that no column has
    out = secret_scan.redact(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col(before))
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_copies", keep_one_of_near_copies), ("secrets", redact_secrets), ("packing", pack)]

#: No SQL: tokenising, MinHash candidates and the fitted classifier have none. Tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each stage's rows written to the shared folder before the next reads them."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
