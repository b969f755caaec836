"""Grouping quality against a human workbook, and threshold sweeps over scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxledger.operators.lineage import Scan

def gold_rows(sheet: DataFrame) -> DataFrame:
    """Rows with their group filled down, one vote by default, blank texts left out."""
    filled = Scan(sheet, ("sheet",), [F.col("row_no")]).add(fills={"_filled": F.col("group")}).done().withColumn("group", F.col("_filled")).drop("_filled")
    return filled.withColumn("votes", F.coalesce("votes", F.lit(1))).where("text is not null and trim(text) <> ''")


def stratified(gold: DataFrame, per_group: int, most: int | None = None) -> DataFrame:
    """The first rows of every group."""
    out = gold.withColumn("_n", F.row_number().over(Window.partitionBy("group").orderBy("row_no"))).where(F.col("_n") <= per_group).drop("_n")
    return out if most is None else out.orderBy("row_no").limit(most)


def replicated(gold: DataFrame, most: int = 10) -> DataFrame:
    """Each row once a vote, ``most`` times at most."""
    return gold.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("votes"), F.lit(most))))))


def predicted_groups(placed: DataFrame) -> DataFrame:
    """Group of each text; the last placement holds."""
    return placed.groupBy("text").agg(F.max_by("group", "ord").alias("predicted"))


def pairwise(items: DataFrame) -> DataFrame:
    """Precision, recall and F1 of "same group" over all pairs of ``items(gold, predicted)``, from counts of the
    contingency table: no pair is made."""
    choose = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = items.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    both = cells.agg(choose("n").alias("tp"))
    by_predicted = cells.groupBy("predicted").agg(F.sum("n").alias("n")).agg(choose("n").alias("p"), F.count("*").alias("predicted_groups"))
    by_gold = cells.groupBy("gold").agg(F.sum("n").alias("n")).agg(choose("n").alias("g"), F.count("*").alias("gold_groups"))
    out = both.crossJoin(by_predicted).crossJoin(by_gold)  # three rows of one
    out = out.withColumn("precision", F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)).withColumn("recall", F.when(F.col("g") > 0, F.col("tp") / F.col("g")).otherwise(0.0))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0)).drop("p", "g")


def wrong_pairs(items: DataFrame, most: int = 12) -> DataFrame:
    """The first pairs that share a predicted group but no gold group, and the other way round. Joins stay inside a
    group and are cut by rank before pairs are made: of any group's first items enough differ, or none do."""

    def kind(same: str, other: str, name: str) -> DataFrame:
        # per group, the first items of each other-label suffice for its first pairs
        w = Window.partitionBy(same, other).orderBy("id")
        few = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
        a, b = few.select(same, F.col("id").alias("a"), F.col(other).alias("oa")), few.select(same, F.col("id").alias("b"), F.col(other).alias("ob"))
        pairs = a.join(b, same).where("a < b and oa <> ob")
        return pairs.select(F.lit(name).alias("kind"), "a", "b").orderBy("a", "b").limit(most)

    return kind("predicted", "gold", "false").unionAll(kind("gold", "predicted", "missed"))


def over_merged(placed: DataFrame) -> DataFrame:
    """Canonical rows that hold several gold rows of one product."""
    return placed.groupBy("canonical", "product").agg(F.countDistinct("gold").alias("n")).where("n > 1")


def sweep(scored: DataFrame) -> DataFrame:
    """Accuracy of ``scored(score, same)`` at 61 thresholds from -0.20 to 1.00. Scores are counted by the step that
    they fall in first, so the rows meet no threshold each."""
    step = F.floor(F.round((F.col("score") + 0.2) / 0.02, 9)).cast("int")
    counts = scored.withColumn("s", F.greatest(F.lit(-1), F.least(F.lit(60), step))).groupBy("s").agg(F.count_if("same").alias("same"), F.count_if(~F.col("same")).alias("other"))
    marks = scored.sparkSession.range(61).select(F.col("id").cast("int").alias("t"))
    met = marks.join(F.broadcast(counts), F.lit(True)).groupBy("t").agg(F.sum(F.when(F.col("s") >= F.col("t"), F.col("same")).otherwise(F.col("other"))).alias("right"), F.sum(F.col("same") + F.col("other")).alias("n"))
    return met.select(F.round(F.col("t") * 0.02 - 0.2, 2).alias("threshold"), (F.col("right") / F.col("n")).alias("accuracy"))


def class_means(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.when(F.col("same"), F.col("score"))).alias("mean_same"), F.avg(F.when(~F.col("same"), F.col("score"))).alias("mean_other"))


def training_pairs(labelled: DataFrame, universal: DataFrame) -> DataFrame:
    """Labelled pairs, and universal pairs that no label covers in either order."""
    taken = labelled.select("a", "b").unionAll(labelled.select(F.col("b"), F.col("a")))
    return labelled.select("a", "b", "label").unionAll(universal.join(taken, ["a", "b"], "left_anti").select("a", "b", "label"))
