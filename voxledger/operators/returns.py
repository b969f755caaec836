"""The returns report: comment topics, stated against true reasons, product summaries and panels.

Every function takes and returns DataFrames. ``returns`` has ``row_seq`` (any orderable column that gives the
ledger's order), return_date, asin, product_name, quantity, reason, customer_comments. The row-level columns are
built-in expressions, so one scan computes them; shuffles are only on ``asin``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.functions import returns_vocabulary as V
from voxledger.operators.lineage import placed

REQUIRED, OPTIONAL = ("asin", "product-name", "reason", "customer-comments"), ("return-date", "quantity")


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def comment_topic(comment: Column, keywords: dict[str, list[str]] = V.TOPIC_KEYWORDS, trivial: list[str] = V.TRIVIAL_COMMENTS) -> Column:
    """Topic of a comment: the first, in order of priority, any of whose phrases the comment contains. One
    alternation a topic keeps the expression small wherever it is pushed to."""
    c = F.lower(F.regexp_replace(comment, r"(?U)^\s+|\s+$", ""))
    out = F.when(comment.isNull() | c.isin(trivial) | (F.length(c) <= 2), "NO_COMMENT")
    for topic, words in keywords.items():
        out = out.when(c.rlike("|".join(map(re.escape, words))), topic)
    return out.otherwise("OTHER")


def status(topic: Column, reason: Column, expected: dict[str, list[str]] = V.EXPECTED_TOPICS) -> Column:
    """Whether the comment's topic is one that the stated reason expects."""
    pairs = [f"{stated}/{fits}" for stated, topics in expected.items() for fits in topics]
    return F.when(topic == "NO_COMMENT", "No Comment").when(topic == "OTHER", "Unclear").when(F.coalesce(F.concat(reason, F.lit("/"), topic).isin(pairs), F.lit(False)), "Match").otherwise("Mismatch")


def true_reason(status_: Column, topic: Column, reason: Column) -> Column:
    return F.when(status_ == "Mismatch", F.coalesce(F.try_element_at(literal_map(V.TRUE_REASON_LABELS), topic), reason)).otherwise(reason)


def classified(returns: DataFrame) -> DataFrame:
    """The ledger with ``comment_topic``, ``status`` and ``true_reason``. The topic comes out of an explode of one value,
    which no filter is moved below, so its patterns are in the plan once, however often the topic is asked for."""
    topics = returns.select("*", F.explode(F.array(comment_topic(F.col("customer_comments")))).alias("comment_topic"))
    known = topics.select("*", F.explode(F.array(status(F.col("comment_topic"), F.col("reason")))).alias("status"))
    return known.withColumn("true_reason", true_reason(F.col("status"), F.col("comment_topic"), F.col("reason")))


def cells(rows: DataFrame) -> DataFrame:
    """Counts of the classified ledger by product, reasons, topic and status, with the first row of each: what the reports
    below are made of, aggregated once."""
    return rows.groupBy("asin", "reason", "comment_topic", "status", "true_reason").agg(F.count("*").alias("n"), F.min("row_seq").alias("first"))


def percent(part: Column, whole: Column) -> Column:
    """Per cent to one place, half to even; 0 of nothing."""
    return F.when(whole > 0, F.bround(part * 100.0 / whole, 1)).otherwise(0.0)


def count_of(name: str) -> Column:
    return F.count_if(F.col("status") == name)


def product_summary(rows: DataFrame) -> DataFrame:
    """One row per product: name of its first row, counts by status, share of mismatches among commented rows,
    and its place in order of first appearance."""
    out = rows.groupBy("asin").agg(
        F.min_by("product_name", "row_seq").alias("product_name"),
        F.count("*").alias("total"),
        F.count_if(F.col("status") != "No Comment").alias("with_comment"),
        count_of("Match").alias("n_match"),
        count_of("Mismatch").alias("n_mismatch"),
        count_of("Unclear").alias("n_unclear"),
        count_of("No Comment").alias("n_no_comment"),
        F.min("row_seq").alias("_first"),
    )
    out = out.withColumn("mismatch_pct", percent(F.col("n_mismatch"), F.col("with_comment")))
    return placed(out, (), [F.col("_first")], "place").drop("_first")


def ranked_counts(counted: DataFrame, column: str, by: tuple[str, ...] = ("asin",)) -> DataFrame:
    """Counts of a column's values within ``by``, ranked: larger first, then first seen. Nulls don't count."""
    counts = counted.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.sum("n").alias("n"), F.min("first").alias("_first"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "_first"))).drop("_first")


def top_true_reasons(rows: DataFrame, k: int = 3) -> DataFrame:
    """The k commonest corrected reasons among a product's mismatches, in columns, padded with ''."""
    ranked = ranked_counts(cells(rows).where("status = 'Mismatch'"), "true_reason").where(F.col("rank") <= k)
    wide = ranked.groupBy("asin").agg(*(F.max(F.when(F.col("rank") == i, F.col("true_reason"))).alias(f"top_{i}") for i in range(1, k + 1)))
    return cells(rows).select("asin").distinct().join(wide, "asin", "left").na.fill("", [f"top_{i}" for i in range(1, k + 1)])


def topic_distribution(rows: DataFrame) -> DataFrame:
    """Topics of commented rows by product, with their share of the commented rows."""
    ranked = ranked_counts(cells(rows).where("comment_topic <> 'NO_COMMENT'"), "comment_topic")
    total = F.sum("n").over(Window.partitionBy("asin"))
    return ranked.withColumn("pct", percent(F.col("n"), total))


def true_reason_distribution(rows: DataFrame) -> DataFrame:
    """Corrected reasons by product with their share of all rows; null reasons are in that whole only."""
    totals = cells(rows).groupBy("asin").agg(F.sum("n").alias("_total"))
    return ranked_counts(cells(rows), "true_reason").join(totals, "asin").withColumn("pct", percent(F.col("n"), F.col("_total"))).drop("_total")


def mismatch_analysis(rows: DataFrame) -> DataFrame:
    """Stated reasons of mismatches by product: count, share of mismatches, commonest corrected reason. Ties go
    by the reason's name, as groups are read in that order."""
    mismatches = cells(rows).where("status = 'Mismatch'")
    top = ranked_counts(mismatches, "true_reason", ("asin", "reason")).where("rank = 1").select("asin", "reason", F.col("true_reason").alias("top_true"))
    counts = mismatches.where("reason is not null").groupBy("asin", "reason").agg(F.sum("n").alias("n"))
    totals = mismatches.groupBy("asin").agg(F.sum("n").alias("_total"))
    out = counts.join(top, ["asin", "reason"], "left").join(totals, "asin").withColumn("pct", percent(F.col("n"), F.col("_total"))).drop("_total")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("asin").orderBy(F.desc("n"), "reason")))


def panels(rows: DataFrame, most: int = 12) -> DataFrame:
    """The three ranked lists of a product side by side, up to ``most`` lines."""
    topics = topic_distribution(rows).where(F.col("rank") <= most).select("asin", "rank", F.col("comment_topic").alias("topic"), F.col("n").alias("topic_n"))
    trues = true_reason_distribution(rows).where(F.col("rank") <= most).select("asin", "rank", "true_reason", F.col("n").alias("true_n"))
    stated = mismatch_analysis(rows).where(F.col("rank") <= most).select("asin", "rank", F.col("reason").alias("stated"), F.col("n").alias("stated_n"), "top_true")
    return topics.join(trues, ["asin", "rank"], "full").join(stated, ["asin", "rank"], "full")


def headline(rows: DataFrame) -> DataFrame:
    """Rows, mismatches and their share of what either matched or not."""
    out = rows.agg(F.count("*").alias("n_rows"), count_of("Mismatch").alias("n_mismatch"), count_of("Match").alias("n_match"))
    return out.select("n_rows", "n_mismatch", percent(F.col("n_mismatch"), F.col("n_mismatch") + F.col("n_match")).alias("mismatch_pct"))


def severity(summary: DataFrame, width: int = 8) -> DataFrame:
    """Band of the mismatch share, name cut to 80 characters, and the share as a bar."""
    p, name = F.col("mismatch_pct"), F.col("product_name")
    filled = F.greatest(F.lit(0), F.least(F.lit(width), F.bround(p / 100 * width, 0).cast("int")))
    return summary.select(
        "asin",
        F.when(p >= 20, "high").when(p >= 10, "medium").otherwise("low").alias("band"),
        F.when(F.length(name) > 80, F.concat(F.substring(name, 1, 80), F.lit("..."))).otherwise(name).alias("short_name"),
        F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled)).alias("bar"),
    )


def detail_order(rows: DataFrame) -> DataFrame:
    """Products by returns, most first; a product's rows newest first, undated last."""
    n = rows.groupBy("asin").agg(F.count("*").alias("n_returns"), F.min("row_seq").alias("_first"))
    n = placed(n, (), [-F.col("n_returns"), F.col("_first")], "asin_rank").drop("_first")
    place = F.row_number().over(Window.partitionBy("asin").orderBy(F.desc_nulls_last("return_date"), "row_seq"))
    return rows.withColumn("row_rank", place).join(n, "asin")


def returned_on(text: Column) -> Column:
    """A return date from text, null where it can't be read."""
    return F.try_to_timestamp(text)


def only_products(returns: DataFrame, wanted: DataFrame) -> DataFrame:
    return returns.join(wanted.select("asin").distinct(), "asin", "left_semi")


def product_list(returns: DataFrame) -> DataFrame:
    return returns.select("asin").where("asin is not null").distinct()
