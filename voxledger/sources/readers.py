"""Readers and writers of ledgers, exports, profiles, rules, labels, snapshots and reports, through Spark's own
sources, so that any path Spark can open will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("asin", "product-name", "reason", "customer-comments")
OPTIONAL = {"return-date": "string", "quantity": "int"}
#: Keys of an override file, and the kinds of rules that they hold.
OVERRIDE_KINDS = {"rename": "rename_group", "rename_canonical": "rename_row", "merge_groups": "merge_groups", "move_canonical": "move_row", "merge_canonicals": "merge_rows", "dual_place": "dual_place"}


def returns_ledger(raw: DataFrame) -> DataFrame:
    """A ledger with its headers stripped and in lower case, optional columns added as null; an error that lists what
    was found where a required column is missing."""
    rows = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if missing := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"missing columns {missing}; found {rows.columns}")
    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    plain = rows.select(*[F.col(f"`{c}`").alias(c.replace("-", "_")) for c in (*REQUIRED, *OPTIONAL)])
    return plain.withColumn("return_date", F.try_to_timestamp(F.col("return_date").cast("string"))).withColumn("row_seq", F.monotonically_increasing_id())


def read_returns_csv(spark: SparkSession, path: str) -> DataFrame:
    return returns_ledger(spark.read.csv(path, header=True))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Extracted review texts, one file each; the file's stem begins the ids of its reviews."""
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(stem.alias("file_stem"), F.col("value").alias("raw_text"))


def mapped_products(exports: DataFrame, products: DataFrame, default: Column) -> DataFrame:
    """Each file's product and link; unmapped files are an error once there is a mapping."""
    out = exports.select("file_stem").distinct().join(F.broadcast(products), "file_stem", "left")
    lost = out.where("name is null").select("file_stem").limit(5).collect() if not products.isEmpty() else []
    if lost:
        raise ValueError(f"files without a product: {[r['file_stem'] for r in lost]}")
    return out.withColumn("name", F.coalesce("name", default))


def profile(spark: SparkSession, categories: list[dict], sheets: list[dict]) -> tuple[DataFrame, DataFrame]:
    """The category profile as tables; one without categories or sheets is an error, never a default."""
    if not categories or not sheets:
        raise ValueError("a profile needs categories and sheets")
    rows = [(i, c["id"], c.get("key", "quote"), c.get("name_from", ""), c.get("group_hint", "")) for i, c in enumerate(categories)]
    pages = [(i, s["title"], s["layout"], list(s["categories"]), dict(s.get("bucket_labels", {}))) for i, s in enumerate(sheets)]
    return (
        spark.createDataFrame(rows, "position int, category string, key string, name_from string, group_hint string"),
        spark.createDataFrame(pages, "position int, title string, layout string, categories array<string>, bucket_labels map<string,string>"),
    )


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Override rules of all kinds from one JSON object, as ``kind, source, target, quote, rule_seq, place``: renames and
    moves are objects of old to new, merges are lists whose first name is kept, dual_place has a quote and its rows."""
    pairs, lists = "map<string,string>", "array<array<string>>"
    shape = f"rename {pairs}, rename_canonical {pairs}, merge_groups {lists}, move_canonical {pairs}, merge_canonicals {lists}, dual_place array<struct<quote: string, rows: array<string>>>"
    one = spark.read.schema(shape).json(path, multiLine=True)
    none, parts = F.lit(None).cast("string"), []
    for name, kind in OVERRIDE_KINDS.items():
        if kind.startswith("merge"):
            rules = one.select(F.posexplode(name).alias("rule_seq", "r")).select("rule_seq", F.get("r", F.lit(0)).alias("target"), F.posexplode("r").alias("place", "source")).where("place > 0")
            parts.append(rules.select(F.lit(kind).alias("kind"), "source", "target", none.alias("quote"), "rule_seq", "place"))
        elif kind == "dual_place":
            rules = one.select(F.posexplode(name).alias("rule_seq", "r")).select("rule_seq", "r.quote", F.posexplode("r.rows").alias("place", "target"))
            parts.append(rules.select(F.lit(kind).alias("kind"), none.alias("source"), "target", "quote", "rule_seq", "place"))
        else:
            rules = one.select(F.posexplode(F.map_entries(name)).alias("rule_seq", "r"))
            parts.append(rules.select(F.lit(kind).alias("kind"), F.col("r.key").alias("source"), F.col("r.value").alias("target"), none.alias("quote"), "rule_seq", F.lit(0).alias("place")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rule_seq", F.col("rule_seq").cast("long"))


def read_gate_labels(spark: SparkSession, root: str, name: str = "gate_labels.json") -> DataFrame:
    """Labels of every product folder, keyed by folder; files that can't be read give no rows."""
    entry = "map<string, struct<category: string, phrase: string, into: string, reason: string, label: string, ts: string>>"
    raw = spark.read.text(f"{root}/*/{name}", wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("product_line"), F.from_json("value", entry, {"mode": "PERMISSIVE"}).alias("m"))
    return raw.select("product_line", F.explode(F.map_entries("m")).alias("e")).select("product_line", "e.key", "e.value.*")


def ledger_from_cells(cells: DataFrame) -> DataFrame:
    """The vote ledger of stored cells ``(canonical_id, product, votes, review_ids, quotes)``: distinct ids and quotes zipped,
    short lists filled with '', counts without ids kept as synthetic ids, each (row, product, review, quote) once."""
    filled = lambda c: F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))
    legacy = F.when((F.size(filled("review_ids")) == 0) & (F.col("votes") > 0), F.transform(F.sequence(F.lit(1), F.greatest(F.col("votes"), F.lit(1)).cast("int")), lambda i: F.concat(F.lit("__legacy_"), i.cast("string")))).otherwise(filled("review_ids"))
    out = cells.withColumn("review_id", legacy).withColumn("quote", filled("quotes")).select("canonical_id", "product", F.explode(F.arrays_zip("review_id", "quote")).alias("z"))
    return out.select("canonical_id", "product", F.coalesce("z.review_id", F.lit("")).alias("review_id"), F.coalesce("z.quote", F.lit("")).alias("quote")).dropDuplicates()


def read_legacy_taxonomy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The legacy layout, one JSON object a product folder, as ``groups, canonicals, cells, quote_sources``, with the folder
    as ``product_line`` and list places as ``ord``. A cell has what any of a row's maps says of a product."""
    counts, lists = "map<string,bigint>", "map<string,array<string>>"
    shape = f"groups array<struct<id: string, category: string, name: string, usage_category: string>>, canonicals array<struct<id: string, text: string, group_id: string, votes: {counts}, quotes: {lists}, review_ids: {lists}, quote_sources: map<string,{lists}>>>"
    one = spark.read.schema(shape).json(path, multiLine=True).withColumn("product_line", F.element_at(F.split("_metadata.file_path", "/"), -2))
    groups = one.select("product_line", F.posexplode("groups").alias("ord", "g")).select("product_line", F.col("g.id").alias("group_id"), "g.category", "g.name", F.nullif("g.usage_category", F.lit("")).alias("usage_category"), "ord")
    rows = one.select("product_line", F.posexplode("canonicals").alias("ord", "c")).select("product_line", F.col("c.id").alias("canonical_id"), "c.*", "ord").drop("id")
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    products = F.array_distinct(F.concat(keys("votes"), keys("quotes"), keys("review_ids")))
    cells = rows.select("product_line", "canonical_id", "votes", "quotes", "review_ids", F.explode(products).alias("product"))
    cells = cells.select("product_line", "canonical_id", "product", F.coalesce(F.col("votes")[F.col("product")], F.lit(0)).alias("votes"), F.col("review_ids")[F.col("product")].alias("review_ids"), F.col("quotes")[F.col("product")].alias("quotes"))
    said = rows.select("product_line", "canonical_id", F.explode("quote_sources").alias("product", "q")).select("product_line", "canonical_id", "product", F.explode("q").alias("quote", "r"))
    return {
        "groups": groups,
        "canonicals": rows.select("product_line", "canonical_id", "group_id", "text", "ord"),
        "cells": cells,
        "quote_sources": said.select("product_line", "canonical_id", "product", "quote", F.explode("r").alias("review_id")).distinct(),
    }


def migrated(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledgers of legacy cells, by product line, and the cells whose votes do not come back from them."""
    keyed = cells.withColumn("canonical_id", F.to_json(F.struct("product_line", "canonical_id")))
    both = F.from_json("canonical_id", "product_line string, canonical_id string")
    plain = lambda d: d.withColumn("_k", both).select("_k.product_line", "_k.canonical_id", *(c for c in d.columns if c != "canonical_id"))
    votes = ledger_from_cells(keyed)
    back = votes.where("review_id <> ''").groupBy("canonical_id", "product").agg(F.countDistinct("review_id").alias("after"))
    compared = keyed.select("canonical_id", "product", F.col("votes").alias("before")).join(back, ["canonical_id", "product"], "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return plain(votes), plain(compared.where("before <> after"))


#: What makes a vote the same vote.
VOTE_KEY = ("canonical_id", "product", "review_id", "quote")


class Snapshots:
    """Versions of a taxonomy's tables under one folder of any store that Spark opens.

    A version's tables are written first, each to a folder of the version's number; the version then comes into being by
    one small commit table. Readers see committed versions only, so a run that is lost between the two leaves the
    state before it, and the next run writes over what was left. A version is whole, or adds votes to those since the
    last whole one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commits(self) -> list[Row]:
        """Committed versions in order, since the last whole one."""
        try:
            rows = self.spark.read.schema("version long, base long").parquet(f"{self.path}/commits/*").orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [r for r in rows if r["version"] >= rows[-1]["base"]] if rows else []

    def commit(self, version: int, base: int) -> None:
        self.spark.createDataFrame([(version, base)], "version long, base long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{version}")

    def at(self, version: int, name: str) -> str:
        return f"{self.path}/version={version}/{name}"

    def save(self, tables: dict[str, DataFrame]) -> int:
        """A whole new version of all tables, votes once each; its number."""
        version = (self.commits() or [{"version": 0}])[-1]["version"] + 1
        for name, df in tables.items():
            (df.dropDuplicates(list(VOTE_KEY)) if name == "votes" else df).write.mode("overwrite").parquet(self.at(version, name))
        self.commit(version, version)
        return version

    def read(self, name: str) -> DataFrame:
        """A table of the latest state."""
        commits = self.commits()
        if not commits:
            raise ValueError(f"no committed version under {self.path}")
        base = commits[0]["base"]
        versions = [r["version"] for r in commits] if name == "votes" else [base]
        return self.spark.read.parquet(*(self.at(v, name) for v in versions))

    def insert_votes(self, votes: DataFrame) -> int:
        """Add the votes whose (row, product, review, quote) isn't there yet, each once; how many they are."""
        commits = self.commits()
        if not commits:
            raise ValueError(f"no committed version under {self.path}")
        version, base = commits[-1]["version"] + 1, commits[-1]["base"]
        there = self.read("votes").select(*(F.col(c).alias(f"_{c}") for c in VOTE_KEY))
        same = F.lit(True)
        for c in VOTE_KEY:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        votes.select(*self.read("votes").columns).dropDuplicates(list(VOTE_KEY)).join(there, same, "left_anti").write.mode("overwrite").parquet(self.at(version, "votes"))
        new = self.spark.read.parquet(self.at(version, "votes")).count()
        if new:
            self.commit(version, base)
        return new


def append_usage(runs: DataFrame, path: str) -> None:
    runs.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Runs, oldest first."""
    return spark.read.parquet(path).drop("date").orderBy("ts")


def write_json(df: DataFrame, path: str) -> None:
    """An intermediate output; a stale one is replaced."""
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A report table as Parquet, or as CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.parquet(path)


def vote_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells whose votes differ between two ledgers."""
    count = lambda d, c: d.where("review_id <> ''").groupBy("canonical_id", "product").agg(F.countDistinct("review_id").alias(c))
    both = count(old, "before").join(count(new, "after"), ["canonical_id", "product"], "full").na.fill(0, ["before", "after"])
    return both.where("before <> after")
