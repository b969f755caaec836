"""The taxonomy as tables: groups, canonicals and the vote ledger(canonical_id, product, review_id, quote).

One review is one vote in a canonical row and product, so votes are always distinct reviews counted from the
ledger, and merging, moving or renaming is a change of keys in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.functions.text import normalize
from voxledger.operators.lineage import Scan, cut, placed


def counted(votes: DataFrame) -> DataFrame:
    """Votes by canonical row and product."""
    return votes.where("review_id <> ''").groupBy("canonical_id", "product").agg(F.countDistinct("review_id").alias("votes"))


def voted(votes: DataFrame) -> DataFrame:
    """Votes by canonical row, over all products."""
    return votes.where("review_id <> ''").groupBy("canonical_id").agg(F.countDistinct(F.struct("product", "review_id")).alias("votes"))


def reconciled(stored: DataFrame, votes: DataFrame) -> DataFrame:
    """Stored counts against the ledger: cells with reviews get their number, cells without keep theirs."""
    return stored.join(counted(votes).withColumnRenamed("votes", "_v"), ["canonical_id", "product"], "left").select("canonical_id", "product", F.coalesce("_v", "votes").alias("votes"), F.greatest(F.col("votes") - F.coalesce("_v", "votes"), F.lit(0)).alias("removed"))


def totals(groups: DataFrame, canonicals: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes by row, group and category as one rollup has them. Rows are counted as they are, so only groups and
    categories are rolled up."""
    rows = voted(votes).join(canonicals.select("canonical_id", "group_id"), "canonical_id").join(groups.select("group_id", "category"), "group_id").select("category", "group_id", "canonical_id", "votes")
    above = rows.rollup("category", "group_id").agg(F.sum("votes").alias("votes"))
    return rows.unionByName(above.withColumn("canonical_id", F.lit(None).cast("string")))


def matrix(votes: DataFrame, products: list[str]) -> DataFrame:
    """Votes of each row by product, 0 where it has none, with the total."""
    wide = counted(votes).groupBy("canonical_id").pivot("product", products).agg(F.sum("votes")).na.fill(0)
    total = F.lit(0)
    for p in products:
        total = total + F.col(f"`{p}`")
    return wide.withColumn("total", total)


def remapped(votes: DataFrame, key: Column) -> DataFrame:
    """The ledger under other product names; reviews that meet count once."""
    return votes.withColumn("product", key).dropDuplicates(["canonical_id", "product", "review_id", "quote"])


def renamed_cells(votes: DataFrame, key: Column) -> DataFrame:
    """How many (row, product) cells get another product name, one row."""
    return votes.withColumn("_k", key).where("_k <> product").agg(F.countDistinct("canonical_id", "product").alias("renamed"))


def products_sheet(mapped: DataFrame) -> DataFrame:
    """The products of mapped files, each with its link."""
    return mapped.groupBy("name").agg(F.min("link").alias("link"))


def folder_status(reviews: DataFrame, groups: DataFrame, canonicals: DataFrame, reports: DataFrame) -> DataFrame:
    """Per product line: export files, reviews, groups, phrases (rows) and the name of the last report; 0 or null where a
    line has none. All tables have ``product_line``; reports have ``name``."""
    parts = [
        reviews.groupBy("product_line").agg(F.countDistinct("stem").alias("files"), F.count("*").alias("reviews")),
        groups.groupBy("product_line").agg(F.count("*").alias("groups")),
        canonicals.groupBy("product_line").agg(F.count("*").alias("phrases")),
        reports.groupBy("product_line").agg(F.max("name").alias("last_report")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "product_line", "full")
    return out.na.fill(0, ["files", "reviews", "groups", "phrases"])


def renames(pairs: DataFrame) -> DataFrame:
    """Old product to new, where all files of the old agree on one."""
    seen = pairs.where("old <> new").groupBy("old").agg(F.countDistinct("new").alias("n"), F.min("new").alias("new"))
    return seen.where("n = 1").select("old", "new")


def merged(votes: DataFrame, merges: DataFrame) -> DataFrame:
    """Votes of merged rows under the row that is kept."""
    out = votes.join(merges.select(F.col("merge_id").alias("canonical_id"), "keep_id"), "canonical_id", "left")
    return out.select(F.coalesce("keep_id", "canonical_id").alias("canonical_id"), "product", "review_id", "quote").dropDuplicates()


def pruned(groups: DataFrame, canonicals: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and rows that still have votes."""
    rows = canonicals.join(votes.where("review_id <> ''"), "canonical_id", "left_semi")
    return groups.join(rows, "group_id", "left_semi"), rows


def dropped(canonicals: DataFrame, votes: DataFrame) -> DataFrame:
    """Rows without votes, for the report of what was pruned."""
    return canonicals.join(votes.where("review_id <> ''"), "canonical_id", "left_anti")


def two_level(groups: DataFrame, canonicals: DataFrame, votes: DataFrame) -> DataFrame:
    """Rows by group and product with subtotals and the places of group, product and row. Sums and places of groups and
    products are made of the sums by group and product, and rows are numbered in ranges, so a large group's rows are in
    no one task."""
    cells = counted(votes).where("votes > 0").join(canonicals.select("canonical_id", "group_id", "text", "ord"), "canonical_id").join(groups.select("group_id"), "group_id", "left_semi")
    scan = Scan(cells, ("group_id", "product"), [-F.col("votes"), F.col("ord")])
    sums = scan.rows.groupBy("group_id", "product").agg(F.sum("votes").alias("subtotal"))
    sums = cut(sums.join(groups.select("group_id", "category", "name"), "group_id"))
    whole = sums.groupBy("category", "group_id", "name").agg(F.sum("subtotal").alias("group_total"))
    places = placed(whole.select("category", "group_total", "name").distinct(), ("category",), [-F.col("group_total"), F.col("name")], "group_place")
    heads = whole.join(places, ["category", "group_total", "name"]).select("group_id", "category", "name", "group_total", "group_place")
    product_place = F.dense_rank().over(Window.partitionBy("group_id").orderBy(F.desc("subtotal"), "product"))  # a row each product
    sides = sums.select("group_id", "product", "subtotal", product_place.alias("product_place")).join(heads, "group_id")
    return scan.add(number="row_place").done().join(sides, ["group_id", "product"]).drop("ord")


def relation_report(groups: DataFrame, canonicals: DataFrame, votes: DataFrame, bucket_labels: DataFrame) -> DataFrame:
    """Votes by bucket (the group's usage category, else its category's label, else Other) and row. Totals come from the
    sums by group, so a bucket isn't one task's."""
    named = groups.join(F.broadcast(bucket_labels), "category", "left").select("group_id", F.coalesce("usage_category", "label", F.lit("Other")).alias("bucket"))
    rows = cut(counted(votes).join(canonicals.select("canonical_id", "group_id"), "canonical_id").join(named, "group_id").groupBy("bucket", "group_id", "canonical_id").agg(F.sum("votes").alias("votes")))
    by_group = rows.groupBy("bucket", "group_id").agg(F.sum("votes").alias("group_total"))
    by_bucket = by_group.groupBy("bucket").agg(F.sum("group_total").alias("bucket_total"))
    return rows.join(by_group.join(by_bucket, "bucket"), ["bucket", "group_id"])


def wish_report(canonicals: DataFrame, votes: DataFrame, sample: int = 2) -> DataFrame:
    """Rows by product with the first quotes of each."""
    quotes = votes.groupBy("canonical_id", "product", "quote").agg(F.min("review_id").alias("r"))
    picked = quotes.withColumn("n", F.row_number().over(Window.partitionBy("canonical_id", "product").orderBy("r", "quote"))).where(F.col("n") <= sample)
    shown = picked.groupBy("canonical_id", "product").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "quote"))), lambda x: x["quote"]), "; ").alias("quotes"))
    return counted(votes).join(shown, ["canonical_id", "product"]).join(canonicals.select("canonical_id", "group_id", "text"), "canonical_id").withColumn("group_total", F.sum("votes").over(Window.partitionBy("group_id")))


def search(canonicals: DataFrame, votes: DataFrame, query: str) -> DataFrame:
    """Rows whose normalised text contains the query's, with their totals."""
    total = voted(votes)
    return canonicals.where(F.contains(normalize(F.col("text")), normalize(F.lit(query)))).join(total, "canonical_id", "left").select("canonical_id", "text", F.coalesce("votes", F.lit(0)).alias("votes"))


def product_view(canonicals: DataFrame, votes: DataFrame, product: str, least: int) -> DataFrame:
    """A product's rows of at least so many votes; groups ranked by what is left of them."""
    rows = counted(votes.where(F.col("product") == product)).where(F.col("votes") >= least).join(canonicals.select("canonical_id", "group_id", "ord"), "canonical_id")
    rows = rows.withColumn("group_votes", F.sum("votes").over(Window.partitionBy("group_id")))
    return rows.withColumn("row_place", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("votes"), "ord"))).drop("ord")


def singletons(canonicals: DataFrame, votes: DataFrame, most: int = 2) -> DataFrame:
    """Groups of one row with few votes."""
    total = voted(votes)
    return canonicals.join(total, "canonical_id", "left").groupBy("group_id").agg(F.count("*").alias("rows"), F.coalesce(F.sum("votes"), F.lit(0)).alias("votes")).where((F.col("rows") == 1) & (F.col("votes") <= most))


def context(groups: DataFrame, canonicals: DataFrame, votes: DataFrame, most: int = 12) -> DataFrame:
    """Groups by total with their first rows in one text, and how many more there are."""
    rows = cut(canonicals.join(voted(votes), "canonical_id").select("group_id", "text", "ord", F.col("votes").alias("v")))
    sums = rows.groupBy("group_id").agg(F.sum("v").alias("total"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    # only the first rows of a group meet: the limit is taken in the tasks that read them, too
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("v"), "ord"))).where(F.col("place") <= most)
    shown = first.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " / ").alias("shown"))
    return sums.join(shown, "group_id").select("group_id", "total", "more", "shown").join(groups.select("group_id", "category", "name"), "group_id")


def variant_counts(canonicals: DataFrame, votes: DataFrame, phrases: DataFrame) -> DataFrame:
    """Distinct raw quotes of each row and product with the phrases that said them, whether a quote is the row's own
    text, and whether the phrases fall short of the votes."""
    said = phrases.groupBy("product", normalize(F.col("quote")).alias("norm")).agg(F.count("*").alias("n"))
    quotes = votes.select("canonical_id", "product", normalize(F.col("quote")).alias("norm")).distinct()
    rows = quotes.join(said, ["product", "norm"], "left").join(canonicals.select("canonical_id", normalize(F.col("text")).alias("own")), "canonical_id")
    rows = rows.select("canonical_id", "product", "norm", F.coalesce("n", F.lit(1)).alias("n"), (F.col("norm") == F.col("own")).alias("is_own"))
    covered = F.sum("n").over(Window.partitionBy("canonical_id", "product"))
    return rows.withColumn("_covered", covered).join(counted(votes), ["canonical_id", "product"]).withColumn("gap", F.col("_covered") < F.col("votes")).drop("_covered")


def by_name(wanted: DataFrame, named: DataFrame, name: str, key: str) -> DataFrame:
    """``wanted(name)`` with the first id whose normalised name it is, over all categories, or null; ``valid`` says
    whether there is one."""
    first = named.groupBy(normalize(F.col(name)).alias("_n")).agg(F.min_by(key, "ord").alias(key))
    out = wanted.withColumn("_w", normalize(F.col("wanted"))).join(first, F.col("_w") == F.col("_n"), "left")
    return out.select("wanted", key, F.col(key).isNotNull().alias("valid"))


def relocated(canonicals: DataFrame, votes: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows moved to other groups of their category by ``moves(group_id, to_group)``; a row whose text the target already
    has, or that another moved row brings, gives its votes to the first such row."""
    there = canonicals.join(moves, "group_id", "left").withColumn("group_id", F.coalesce("to_group", "group_id")).drop("to_group").withColumn("_n", normalize(F.col("text")))
    twins = there.withColumn("keep_id", F.first("canonical_id").over(Window.partitionBy("group_id", "_n").orderBy("ord")))
    merges = twins.where("canonical_id <> keep_id").select(F.col("canonical_id").alias("merge_id"), "keep_id")
    return twins.where("canonical_id = keep_id").drop("_n", "keep_id"), merged(votes, merges)
