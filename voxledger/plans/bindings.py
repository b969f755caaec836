"""The tables of the reports, derived from the generic tables, in Spark and in SQL alike.

The generic tables hold no return comments or reviews, so each derived table is a deterministic expression over
whole tables: ``returns`` over lineitem and part, ``usage`` over events, ``phrases`` and ``reviews`` over
documents, and so on. SQL forms are common table expressions of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.functions.text import normalize
from voxledger.operators.lineage import cut

COMMENTS = ["Too large for me", "wrong size", "does not fit well", "nice fit overall", "fit", "a leak happened", "it has a leak", "not the same quality, it broke", "doesn't work", "smaller than the picture", "too big", "love it", None, "N/A", " ok ", "ab", "Poor quality and flimsy", "not as described", "wrong item sent", "never arrived", "changed my mind", "found cheaper elsewhere", "too tight", "material is thin", "arrived late"]
REASONS = ["APPAREL_TOO_LARGE", "ORDERED_WRONG_ITEM", "POOR_FIT", "DEFECTIVE", "QUALITY_UNACCEPTABLE", "NO_REASON_GIVEN", None, "SOMETHING_ELSE", "UNWANTED_ITEM", "APPAREL_TOO_SMALL", "NOT_AS_DESCRIBED", "NEVER_ARRIVED", "FOUND_BETTER_PRICE", "SWITCHEROO"]
ROW = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where the files make fewer tasks than there are cores; large tables make more."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def sql_list(xs) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % len(xs) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.struct(*ROW).alias("row_seq"), F.col("l_shipdate").alias("return_date"), F.col("p_brand").alias("asin"), F.col("p_name").alias("product_name"), F.col("l_quantity").cast("int").alias("quantity"), pick(REASONS).alias("reason"), pick(COMMENTS).alias("customer_comments"))


RETURNS_SQL = f"""returns AS (
  SELECT row_number() OVER (ORDER BY {", ".join(ROW)}) AS row_seq, l_shipdate AS return_date, p_brand AS asin, p_name AS product_name,
    CAST(trunc(l_quantity) AS INTEGER) AS quantity,
    ({sql_list(REASONS)})[CAST((l_orderkey * 7 + l_linenumber * 3) % {len(REASONS)} + 1 AS INTEGER)] AS reason,
    ({sql_list(COMMENTS)})[CAST((l_orderkey * 7 + l_linenumber * 3) % {len(COMMENTS)} + 1 AS INTEGER)] AS customer_comments
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        "ts",
        F.concat(F.lit("line"), (F.col("user_id") % 7).cast("string")).alias("product_line"),
        F.concat(F.lit("provider/Model-"), F.col("event_type"), F.lit("-20240101")).alias("extract_model"),
        F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("group_model"),
        (F.col("event_id") % 1000 * 13 + 100).alias("input_tokens"),
        (F.col("event_id") % 700 * 3 + 10).alias("output_tokens"),
        (F.col("event_id") % 50).alias("cache_read_tokens"),
        (F.col("event_id") % 20).alias("cache_write_tokens"),
        # whole cents: sums of them do not depend on the order of addition
        F.floor(F.col("value") * 100).cast("long").alias("cost_usd"),
        (F.col("event_type") != "error").alias("cost_known"),
    )


USAGE_SQL = """usage AS (
  SELECT event_id AS run_id, ts, 'line' || CAST(user_id % 7 AS VARCHAR) AS product_line, 'provider/Model-' || event_type || '-20240101' AS extract_model,
    'model-' || CAST(user_id % 3 AS VARCHAR) AS group_model, event_id % 1000 * 13 + 100 AS input_tokens, event_id % 700 * 3 + 10 AS output_tokens,
    event_id % 50 AS cache_read_tokens, event_id % 20 AS cache_write_tokens, CAST(floor(value * 100) AS BIGINT) AS cost_usd, event_type <> 'error' AS cost_known FROM events)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review a document: file and product from its source, author from its language."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d.cast("string").alias("review_id"), F.col("source").alias("file"), F.concat(F.col("source"), F.when(d % 2 == 0, "_positive").otherwise("_negative")).alias("stem"), F.col("lang").alias("author"), F.when(d % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (d % 365).cast("int"))).alias("review_date"), F.col("text").alias("body"), d.alias("seq"))


REVIEWS_SQL = """reviews AS (
  SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS file, source || CASE WHEN doc_id % 2 = 0 THEN '_positive' ELSE '_negative' END AS stem, lang AS author,
    CASE WHEN doc_id % 11 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) END AS review_date, text AS body, doc_id AS seq FROM documents)"""


#: Numbers of sentences that a document's phrases are numbered within.
MOST_SENTENCES = 1 << 24


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences of documents as tagged quotes: category from the language, product from the source."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", F.posexplode(F.split("text", r"\.", -1)).alias("pos", "raw"))
    return rows.withColumn("quote", F.trim("raw")).where("quote <> ''").select("quote", F.col("lang").alias("category"), F.col("source").alias("product"), F.col("doc_id").cast("string").alias("review_id"), (F.col("doc_id") * MOST_SENTENCES + F.col("pos")).alias("phrase_seq"))


PHRASES_SQL = f"""phrases AS (
  SELECT * FROM (SELECT trim(unnest(string_split(text, '.'))) AS quote, lang AS category, source AS product, CAST(doc_id AS VARCHAR) AS review_id,
    doc_id * {MOST_SENTENCES} + unnest(generate_series(0, len(string_split(text, '.')) - 1)) AS phrase_seq FROM documents) WHERE quote <> '')"""


def sql_norm(column: str) -> str:
    """The normalised text: accents become blanks after their letter, other marks become blanks."""
    bare = f"strip_accents(regexp_replace(replace(lower({column}), 'ß', 'ss'), '([àáâãäåçèéêëìíîïñòóôõöùúûüýÿ])', '\\1 ', 'g'))"
    return f"trim(regexp_replace(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))"


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases whose normalised text, ``text``, isn't empty. A filter on it would normalise each text twice; one ASCII
    letter, digit or underscore, which always stays, tells nearly all."""
    quote = F.col("quote")
    return phrases(spark, sf_dir).where(quote.rlike("[A-Za-z0-9_]") | (normalize(quote) != "")).withColumn("text", normalize(quote))


def texts(worded: DataFrame) -> DataFrame:
    """A row for each distinct normalised quote of a category, with its first place."""
    return worded.groupBy("category", "text").agg(F.min("phrase_seq").alias("ord"))


def ledger(spark: SparkSession, sf_dir: str, again: bool = False, repeats: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """groups, canonicals and votes made of the phrases: a row for each distinct normalised quote, a group for
    each first word of one. With ``again``, for who reads them several times, rows are written once and groups are made
    of them. With ``repeats`` a quote that a review says twice is two votes, for who counts distinct ones."""
    p = worded(spark, sf_dir)
    key = lambda *c: F.concat_ws("|", *c)
    rows = texts(p)
    rows = cut(rows) if again else rows
    first = F.substring_index("text", " ", 1).alias("first")
    named = (rows if again else p.withColumnRenamed("phrase_seq", "ord")).groupBy("category", first).agg(F.min("ord").alias("ord"))
    canonicals = rows.select(key("category", "text").alias("canonical_id"), key("category", first).alias("group_id"), "text", "ord")
    groups = named.select(key("category", "first").alias("group_id"), "category", F.col("first").alias("name"), F.when(F.length("first") > 4, F.lit("long")).alias("usage_category"), "ord")
    votes = p.select(key("category", "text").alias("canonical_id"), "product", "review_id", "quote")
    return groups, canonicals, votes if repeats else votes.distinct()


LEDGER_SQL = (
    PHRASES_SQL
    + f""", norm AS (SELECT *, {sql_norm("quote")} AS text FROM phrases),
  named AS (SELECT *, string_split(text, ' ')[1] AS first FROM norm WHERE text <> ''),
  canonicals AS (SELECT category || '|' || text AS canonical_id, category || '|' || first AS group_id, text, min(phrase_seq) AS ord FROM named GROUP BY category, text, first),
  groups AS (SELECT category || '|' || first AS group_id, category, first AS name, CASE WHEN length(first) > 4 THEN 'long' END AS usage_category, min(phrase_seq) AS ord FROM named GROUP BY category, first),
  votes AS (SELECT DISTINCT category || '|' || text AS canonical_id, product, review_id, quote FROM named)"""
)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("object_key"), F.length("html").cast("long").alias("size"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 3600).alias("last_modified"))


MANIFEST_SQL = "manifest AS (SELECT page_id AS object_key, CAST(length(html) AS BIGINT) AS size, page_id AS last_modified FROM pages)"


def gate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rows.select(F.col("lang").alias("category"), F.concat(F.lit("p"), (F.col("doc_id") % 40).cast("string")).alias("phrase"), F.concat(F.lit("p"), (F.col("doc_id") % 23).cast("string")).alias("into"), F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("rule"), (F.col("doc_id") % 5).cast("string"))).alias("reason"), F.when(F.col("quality") == 1, "keep").otherwise("merge").alias("label"), F.col("doc_id").alias("ts"), F.col("source").alias("product_line"))


GATE_LABELS_SQL = """gate_labels AS (
  SELECT lang AS category, 'p' || CAST(doc_id % 40 AS VARCHAR) AS phrase, 'p' || CAST(doc_id % 23 AS VARCHAR) AS into_, CASE WHEN doc_id % 9 <> 0 THEN 'rule' || CAST(doc_id % 5 AS VARCHAR) END AS reason,
    CASE WHEN quality = 1 THEN 'keep' ELSE 'merge' END AS label, doc_id AS ts, source AS product_line FROM labels JOIN documents USING (doc_id))"""
