"""Tagged quotes: joins with reviews, containment, unique phrases, batches for a judge."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.functions.text import normalize
from voxledger.operators.lineage import Scan, placed


def with_review(phrases: DataFrame, reviews: DataFrame) -> DataFrame:
    """Phrases with their review's text; a phrase of an unknown review stays."""
    return phrases.join(reviews.select("review_id", "body"), "review_id", "left")


#: Phrases of one (product, review, category) that are looked through together; those of larger groups meet in a join.
TOGETHER = 20_000


def contained(phrases: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``a, b``: phrases of one (product, review, category) where a's words are a proper run of b's. A review's phrases are
    sent once and looked up by their rarest words; where one group has more than ``together``, they meet on the first
    word of a, spread over the tasks."""
    key = ["product", "review_id", "category"]
    words = F.regexp_extract_all(F.lower("quote"), F.lit(r"(?U)\w+"), 0)
    rows = phrases.na.drop(subset=[*key, "phrase_seq"]).select(*key, "phrase_seq", F.array_join(words, " ").alias("text")).where("text <> ''")
    large = F.broadcast(phrases.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > together).select(*key))  # one for ``together`` rows at most
    kind = phrases.schema["phrase_seq"].dataType.simpleString()
    small = rows.join(large, key, "left_anti").groupBy(*key).agg(F.collect_list(F.struct("phrase_seq", "text")).alias("_rows")).select("_rows")
    return small.mapInArrow(_pairs_within, f"a {kind}, b {kind}").unionByName(_contained_by_join(rows.join(large, key, "left_semi")))


def _contained_by_join(rows: DataFrame) -> DataFrame:
    key = ["product", "review_id", "category", "word"]
    words = rows.withColumn("ws", F.split("text", " "))
    a = words.select(*key[:-1], F.get("ws", F.lit(0)).alias("word"), F.col("phrase_seq").alias("a"), F.col("text").alias("aw"), F.size("ws").alias("an"))
    b = words.select(*key[:-1], F.explode(F.array_distinct("ws")).alias("word"), F.col("phrase_seq").alias("b"), F.col("text").alias("bw"), F.size("ws").alias("bn"))
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return a.join(b, key).where((F.col("a") != F.col("b")) & (F.col("an") < F.col("bn")) & F.contains(padded("bw"), padded("aw"))).select("a", "b")


class Runs:
    """Distinct texts of words with blanks between, each under the word that is rarest among the first of them."""

    def __init__(self, texts):
        self.texts = {t: t.split(" ") for t in texts}
        self.often = Counter(w for ws in self.texts.values() for w in set(ws))
        self.under: dict[str, list[str]] = {}
        for t in self.texts:
            self._put(t)

    def _put(self, text: str) -> None:
        self.under.setdefault(min(self.texts[text], key=lambda w: self.often[w]), []).append(text)

    def add(self, text: str) -> None:
        if text not in self.texts:
            self.texts[text] = text.split(" ")
            self._put(text)

    def inside(self, text: str) -> list[str]:
        """The texts whose words are a proper run of this one's."""
        padded, ws = f" {text} ", text.split(" ")
        return [t for w in set(ws) for t in self.under.get(w, ()) if len(self.texts[t]) < len(ws) and f" {t} " in padded]


#: Pairs that leave a task together.
PAIRS = 100_000


def _pairs_within(batches):
    for batch in batches:
        kind = batch.schema.field(0).type.value_type.field("phrase_seq").type
        batch_of = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])  # noqa: B023, E731
        a, b = [], []
        for rows in batch.column(0):
            said: dict[str, list] = {}
            for r in rows.as_py():
                said.setdefault(r["text"], []).append(r["phrase_seq"])
            runs = Runs(said)
            for text, outer in said.items():
                for inner in runs.inside(text):
                    for y in outer:
                        more = [x for x in said[inner] if x != y]
                        a += more
                        b += [y] * len(more)
                        if len(a) >= PAIRS:
                            yield batch_of(a, b)
                            a, b = [], []
        yield batch_of(a, b)


def keyed(phrases: DataFrame, relations: tuple[str, ...] = ()) -> DataFrame:
    """Phrases with the text that they are one by, and its normalised form: the relation in categories keyed by relation,
    where there is one, else the quote."""
    text = F.col("quote")
    if relations:
        text = F.when(F.col("category").isin(*relations), F.coalesce(F.nullif("relation", F.lit("")), text)).otherwise(text)
    return phrases.withColumn("key_text", text).withColumn("norm", normalize(F.col("key_text")))


def unique_phrases(phrases: DataFrame, relations: tuple[str, ...] = ()) -> DataFrame:
    """Phrases by category and normalised key: first wording with its relation and gist, and per product counts of phrases,
    raw quotes and reviews; the total and the first place give the order. ``unique_pairs`` has who said what."""
    rows = keyed(phrases, relations)
    for c in ("relation", "gist"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    # a phrase and a quote are known by 128 bits, so that wordings are shuffled once; what is normalised holds no NUL
    mark = lambda c: F.unhex(F.md5(c.cast("binary")))
    key = F.concat(F.coalesce(F.concat(F.lit("c"), "category"), F.lit("")), F.lit("\0"), F.coalesce(F.concat(F.lit("n"), "norm"), F.lit("")))
    rows = rows.withColumn("_key", mark(key))
    said = F.struct("category", F.trim("key_text").alias("text"), "relation", "gist")
    first = rows.groupBy("_key").agg(F.min_by(said, "phrase_seq").alias("_q"), F.min("phrase_seq").alias("first_seq"))
    marked = rows.select("_key", "product", "review_id", mark(F.col("quote")).alias("_quote"))
    cells = marked.groupBy("_key", "product").agg(F.count("*").alias("n"), F.countDistinct("_quote").alias("quotes"), F.countDistinct(F.nullif("review_id", F.lit(""))).alias("reviews"))
    cells = cells.withColumn("total", F.sum("n").over(Window.partitionBy("_key")))  # a row each product
    out = cells.join(first, "_key")
    return out.select("_q.category", normalize(F.col("_q.text")).alias("norm"), "product", "n", "quotes", "reviews", "total", "_q.text", "_q.relation", "_q.gist", "first_seq")


def unique_pairs(phrases: DataFrame, relations: tuple[str, ...] = ()) -> DataFrame:
    """``category, norm, product, review_id, quote``: which review said which quote of a unique phrase."""
    return keyed(phrases, relations).where("review_id <> '' and quote <> ''").select("category", "norm", "product", "review_id", "quote").distinct()


def placed_exactly(uniques: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Phrases whose normalised text is a row's: all rows of that text, in whatever group, get them."""
    rows = canonicals.withColumn("norm", normalize(F.col("text"))).select("category", "norm", "canonical_id")
    return uniques.join(rows, ["category", "norm"])


def chunked(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Rows of each ``by`` in runs of ``size``."""
    return placed(rows, (by,), [F.col(order)], "_place").withColumn("chunk", F.floor((F.col("_place") - 1) / size)).drop("_place")


def request_batches(reviews: DataFrame, size: int = 8) -> DataFrame:
    """Consecutive runs of one product within a file, cut into chunks of ``size``: a batch never spans products."""
    scan = Scan(reviews, ("file",), [F.col("seq")]).add(number="_n", lags={"_before": F.col("product")})
    new = ~F.coalesce(F.col("_before") == F.col("product"), F.lit(False))
    out = scan.add(sums={"run": new.cast("int")}, fills={"_start": F.when(new, F.col("_n"))}).done()
    return out.withColumn("batch", F.floor((F.col("_n") - F.col("_start")) / size)).drop("_n", "_before", "_start")


def budgeted(groups: DataFrame, budget: int = 120) -> DataFrame:
    """Groups of a category, largest first, in calls of about ``budget`` rows."""
    out = Scan(groups, ("category",), [-F.col("total"), F.col("ord")]).add(sums={"_until": F.col("n_rows")}).done()
    return out.withColumn("call", F.floor((F.col("_until") - F.col("n_rows")) / budget)).drop("_until")


def uncached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose answer isn't in the cache."""
    return requests.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def first_written(entries: DataFrame) -> DataFrame:
    """Cache entries, the earliest of each key."""
    return entries.groupBy("cache_key").agg(F.min_by("response_text", "seq").alias("response_text"), F.min("seq").alias("seq"))


def answered(raw: DataFrame, categories: DataFrame) -> DataFrame:
    """Quotes from a judge's loosely written JSON: the outermost object is read, blank quotes and categories that
    the profile lacks go."""
    shape = "struct<quotes: array<struct<index: int, quote: string, categories: array<string>>>>"
    parsed = raw.withColumn("j", F.from_json(F.regexp_extract("response_text", r"(?s)\{.*\}", 0), shape))
    rows = parsed.select("batch_key", "n_reviews", F.explode("j.quotes").alias("q")).select("batch_key", "n_reviews", "q.index", "q.quote", F.explode("q.categories").alias("category"))
    return rows.where("index between 1 and n_reviews and trim(quote) <> ''").join(categories.select("category"), "category", "left_semi")


def cache_key(requests: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Requests with the SHA-256 of all that an answer depends on."""
    return requests.withColumn("cache_key", F.sha2(F.to_json(F.struct(*columns)), 256))


def instructions(categories: DataFrame, header: str, footer: str, default: str = "a relevant customer phrase.") -> DataFrame:
    """The system text of a profile ``(position, category, extract_rule)``, one row: a line for each category, in order."""
    line = F.concat(F.lit("   - "), "category", F.lit(": "), F.coalesce(F.nullif(F.trim("extract_rule"), F.lit("")), F.lit(default)))
    listed = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return categories.agg(F.concat(F.lit(header), F.array_join(F.transform(listed, lambda x: x["line"]), "\n"), F.lit("\n" + footer)).alias("system"))


def rendered(batches: DataFrame, by: tuple[str, ...], order: str, line: Column, system: DataFrame) -> DataFrame:
    """Each batch's request: its lines numbered from 0, a blank line between, and the system text."""
    listed = F.array_sort(F.collect_list(F.struct(order, F.coalesce(line, F.lit("")).alias("line"))))
    lines = F.transform(listed, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x["line"]))
    return batches.groupBy(*by).agg(F.concat(F.lit("Reviews:\n\n"), F.array_join(lines, "\n\n")).alias("request")).crossJoin(F.broadcast(system))  # one row
