"""Review exports to reviews: segmentation, cleaning, dedup, limits, parse statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.operators.lineage import placed

# The marks that an export's layout consists of.
RATING = r"(?iU)(\d(?:[.,]\d)?)\s*out\s*of\s*5\s*stars?"
DATE = r"(?U)Reviewed in (?:the )?[\w\s]+? on\s+([A-Z][a-z]+ \d{1,2}, \d{4})"
VARIANT = r"(?U)\b(?:Size|Color|Colour|Style|Pattern|Flavor|Flavour|Scent|Number of Items|Package Quantity)\s*(?:Name)?\s*:\s*"
TRAILER = r"(?iU)(?:\d+\s+people found this helpful\s*|One person found this helpful\s*)?Helpful\s*\|?\s*Report(?:\s+abuse)?"
NOISE = [r"Click to play video", r"Video Player is loading.*?(?:Transcript|$)", r"\d+\s+people found this helpful", r"One person found this helpful", r"Helpful\s*\|?\s*Report(?:\s+abuse)?", r"Read more", r"See more reviews?", r"Translate review to English"]
VERIFIED = r"Verified Purchase|Vine Customer"
MARK = "\x01"


def cleaned(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?U)\s+", " ")
    for pattern in NOISE:
        out = F.regexp_replace(out, "(?iU)" + pattern, " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def parsed_date(text: Column) -> Column:
    """Date written as ``Month D, YYYY``; null where there is none such."""
    return F.to_date(F.try_to_timestamp(text, F.lit("MMMM d, yyyy")))


def before(text: Column, pattern: str) -> Column:
    """What precedes the first match, or the whole text."""
    return F.element_at(F.split(text, pattern, 2), 1)


def after(text: Column, pattern: str) -> Column:
    """What follows the first match, or null."""
    return F.try_element_at(F.split(text, pattern, 2), F.lit(2))


def segmented(exports: DataFrame) -> DataFrame:
    """One row per rating mark of ``exports(file_stem, raw_text)``: ``review_id`` (mark's index in the file, other
    marks counted), author, rating, title, review_date, variant, body, is_review.

    Array work on one text column: no shuffle. The author is what follows the trailer of the segment before; a
    segment without trailer leaves the next without author; the first mark takes it from the file's head.
    """
    text = F.regexp_replace("raw_text", r"(?U)\s+", " ")
    rows = exports.select("file_stem", F.split(text, RATING, -1).alias("segs"), F.regexp_extract_all(text, F.lit(RATING), 1).alias("marks"))
    head = F.element_at("segs", 1)
    in_head = F.split(head, TRAILER, -1)
    last_words = lambda t: F.array_join(F.slice(F.split(t, " "), F.greatest(F.size(F.split(t, " ")) - 5, F.lit(1)), 6), " ")
    first_author = F.when(F.size(in_head) > 1, cleaned(F.element_at(in_head, -1))).otherwise(last_words(cleaned(head)))
    rows = rows.withColumn("first_author", first_author).select("file_stem", "segs", "first_author", F.posexplode("marks").alias("i", "mark"))
    rows = rows.withColumn("seg", F.element_at("segs", F.col("i") + 2)).withColumn("prior", F.when(F.col("i") > 0, F.element_at("segs", F.greatest(F.col("i"), F.lit(1)) + 1)))
    author = F.when(F.col("i") == 0, F.col("first_author")).otherwise(F.coalesce(cleaned(after(F.col("prior"), TRAILER)), F.lit("")))
    rows = rows.withColumn("author", author).withColumn("seg", before(F.col("seg"), TRAILER)).withColumn("rest", after(F.col("seg"), DATE))
    rows = rows.withColumn("date_text", F.regexp_extract("seg", DATE, 1)).withColumn("start", F.substring("rest", 1, 200))
    has_variant = F.col("start").rlike(VARIANT)
    tail = F.when(has_variant, after(F.col("rest"), VARIANT))
    rows = rows.withColumn("tail", tail).withColumn("stopped", F.col("tail").rlike(VERIFIED))
    words = F.array_join(F.slice(F.split(cleaned(F.substring("tail", 1, 80)), " "), 1, 6), " ")
    variant = F.when(F.col("tail").isNull(), "").when(F.col("stopped"), cleaned(before(F.col("tail"), VERIFIED))).otherwise(words)
    left = F.when(F.col("tail").isNull(), F.col("rest")).when(F.col("stopped"), F.substring(F.col("tail"), F.length(before(F.col("tail"), VERIFIED)) + 1, F.length("tail"))).otherwise(F.substring(F.col("tail"), F.lit(81), F.length("tail")))
    body = cleaned(F.regexp_replace(left, r"(?U)^\s*(?:Verified Purchase|Vine Customer Review of Free Product)\s*", ""))
    return rows.select(
        "file_stem",
        F.concat_ws(":", "file_stem", "i").alias("review_id"),
        "author",
        F.replace("mark", F.lit(","), F.lit(".")).cast("double").alias("rating"),
        F.when(F.col("rest").isNotNull(), cleaned(before(F.col("seg"), DATE))).alias("title"),
        parsed_date(F.col("date_text")).alias("review_date"),
        variant.alias("variant"),
        body.alias("body"),
        F.col("rest").isNotNull().alias("is_review"),
    )


def parsed(exports: DataFrame) -> DataFrame:
    return segmented(exports).where("is_review").drop("is_review")


def parse_stats(exports: DataFrame) -> DataFrame:
    """Per file: date marks, parsed reviews, and what was lost."""
    text = F.regexp_replace("raw_text", r"(?U)\s+", " ")
    expected = exports.select("file_stem", F.size(F.regexp_extract_all(text, F.lit(DATE), 0)).alias("expected"))
    found = segmented(exports).groupBy("file_stem").agg(F.count_if("is_review").alias("parsed"))
    return expected.join(found, "file_stem", "left").select("file_stem", "expected", F.coalesce("parsed", F.lit(0)).alias("parsed"), (F.col("expected") - F.coalesce("parsed", F.lit(0))).alias("lost"))


def deduplicated(reviews: DataFrame) -> DataFrame:
    """First of the reviews of one file that agree in author, date and whole body. Bodies meet by hash; the hash of
    two kinds makes 128 bits."""
    same = Window.partitionBy("file", "author", "review_date", F.xxhash64("body"), F.xxhash64(F.lit(1), "body")).orderBy("seq")
    return reviews.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def newest(reviews: DataFrame, cutoff: str | None = None, most: int | None = None) -> DataFrame:
    """Newest first within a file, undated last; those before the cutoff go, undated ones stay; at most ``most``, whom each
    task picks before the rows of a file meet."""
    if cutoff is not None:
        reviews = reviews.where(F.col("review_date").isNull() | (F.col("review_date") >= F.lit(cutoff).cast("date")))
    if most is None:
        return placed(reviews, ("file",), [F.col("review_date").isNull(), -F.unix_date("review_date"), F.col("seq")], "place")
    return reviews.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy(F.desc_nulls_last("review_date"), "seq"))).where(F.col("place") <= most)


def lost_contexts(exports: DataFrame, before_: int = 150, after_: int = 250, most: int = 10) -> DataFrame:
    """Text around the date marks of each file that became no review's, ``most`` a file for the log."""
    text = F.regexp_replace("raw_text", r"(?U)\s+", " ")
    rows = exports.select("file_stem", text.alias("t")).withColumn("segs", F.split("t", RATING, -1))
    # in a segment after a rating mark, the first date before its trailer has an owner; any other date has none
    rows = rows.select("file_stem", F.posexplode("segs").alias("i", "seg"))
    parts = rows.select("file_stem", "i", "seg", F.split("seg", DATE, -1).alias("p"), F.regexp_extract_all("seg", F.lit(DATE), 0).alias("d"), F.length(before(F.col("seg"), TRAILER)).alias("cut"))
    dates = parts.select("file_stem", "i", "p", "d", "cut", F.posexplode("d").alias("k", "mark"))
    head = F.aggregate(F.slice(F.arrays_zip(F.col("p"), F.col("d")), 1, F.greatest(F.col("k"), F.lit(0))), F.lit(""), lambda a, x: F.concat(a, F.coalesce(x["p"], F.lit("")), F.coalesce(x["d"], F.lit(""))))
    found = dates.withColumn("head", F.concat(head, F.element_at("p", F.col("k") + 1))).withColumn("owned", (F.col("i") > 0) & (F.col("k") == 0) & (F.length("head") < F.col("cut")))
    tail = F.substring(F.element_at("p", F.col("k") + 2), 1, after_)
    lost = found.where("not owned").select("file_stem", "i", "k", cleaned(F.concat(F.expr(f"right(head, {before_})"), F.col("mark"), tail)).alias("context"))
    return lost.withColumn("n", F.row_number().over(Window.partitionBy("file_stem").orderBy("i", "k"))).where(F.col("n") <= most).select("file_stem", "n", "context")
