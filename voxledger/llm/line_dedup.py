"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Each line is the set of its character shingles. Its MinHash signature is that of one permutation: every shingle's hash
falls into one of BINS bins, and the least of each bin is a row of the signature; a line with few shingles draws each
several times, so that hardly a bin stays empty. One aggregation over the exploded shingles makes all rows, map-side
first, by distinct line. All lines that agree in a band of the signature are compared, in two steps:

* each with the bucket's leader, its least line;
* then all other pairs of a bucket that the first step's links leave in different components (pairs within one
  cannot change the result). Large buckets are cut into blocks, and the pairs of blocks are dealt over the tasks.

Before a pair's texts are fetched, the rows in which the two signatures agree are counted by their low bytes: a pair at
the threshold agrees in fewer than ``least_rows`` with a chance of 1 in 500 at most. The Jaccard index of each pair left is
computed exactly, and distributed union-find joins what reaches the threshold. Of each component the first occurrence
(smallest document, then line number) stays.

Lines are known by 64-bit hashes of their text: among n distinct lines n*n/2**65 pairs are expected to share one.

Edge cases: null text has no lines; blank lines are layout, always kept and in no component; a line shorter than
a shingle is one shingle; repeated rows of one document (same id and text) are read as one document, whose line stays
in each; rows with one id and different texts are documents of their own, told apart by a hash of the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.common import components, cut

#: Twelve bands of four rows miss a pair at the threshold of 0.8 with a chance of 0.0018.
SIZE, BANDS, ROWS = 5, 12, 4
BINS = BANDS * ROWS
#: Draws that a line makes at least: its shingles, as often each as it takes.
DRAWS = 160
#: Lines of a block of a large bucket.
BLOCK = 256
#: The low bytes of the signature's rows, eight in a 64-bit word.
LANES = [f"w{k}" for k in range(BINS // 8)]
#: Bits of the bitmaps by which rows are sorted out before a shuffle: 8 MB, whatever the corpus.
BITS = 1 << 26


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, version, line_no, line, line_id`` of all lines that aren't blank; ``version`` is a hash of the text."""
    every = docs.select(id_col, F.xxhash64(text_col).alias("version"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return every.where(F.trim("line") != "").withColumn("line_id", F.xxhash64("line"))


def wide(line: str) -> Column:
    """The line with two bytes for each character, so that shingles are cut by offset."""
    return F.encode(F.col(line), "UTF-16BE")


def starts(width: Column, size: int) -> Column:
    """Places of the shingles in the two-byte form, from 1, two apart."""
    return F.sequence(F.lit(1), F.greatest(width - 2 * size + 1, F.lit(1)), F.lit(2))


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """``line_id, keys, w0..``: one 64-bit key for each band, and the low bytes of the rows."""
    at = rows.select("line_id", wide("line").alias("w")).withColumn("n", F.greatest(F.octet_length("w") / 2 - size + 1, F.lit(1)).cast("int"))
    drawn = at.select("line_id", "w", "n", F.explode(F.sequence(F.lit(0), F.col("n") * F.ceil(DRAWS / F.col("n")).cast("int") - 1)).alias("i"))
    hashed = drawn.select("line_id", F.xxhash64(F.substring("w", F.expr("i % n * 2 + 1"), F.lit(2 * size)), F.expr("i div n")).alias("h"))
    # the upper half of the hash chooses the bin, the lower half is what the bin's least is taken of
    binned = hashed.select("line_id", F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(h, 32) * {BINS}, 32) as int)").alias("bin"), F.expr("cast(shiftright(shiftleft(h, 32), 32) as int)").alias("v"))
    least = binned.groupBy("line_id").agg(*(F.expr(f"min(v) FILTER (WHERE bin = {k})").alias(f"m{k}") for k in range(BINS)))
    band = lambda b: F.xxhash64(F.lit(b), *(f"m{b * ROWS + k}" for k in range(ROWS)))
    lane = lambda w: F.expr(" | ".join(f"shiftleft(cast(coalesce(m{8 * w + j}, 0) & 255 as bigint), {8 * j})" for j in range(8)))
    return least.select("line_id", F.array(*map(band, range(BANDS))).alias("keys"), *(lane(w).alias(x) for w, x in enumerate(LANES)))


def least_rows(threshold: float, loss: float = 2e-3) -> int:
    """Most rows that a pair at the threshold agrees in but for a chance of ``loss``."""
    below, t = 0.0, 0
    while (below := below + math.comb(BINS, t) * threshold**t * (1 - threshold) ** (BINS - t)) <= loss:
        t += 1
    return t


def rows_agree(threshold: float) -> Column:
    """Whether the signatures ``a_`` and ``b_`` agree in as many rows as a pair at the threshold does."""
    ones = "72340172838076673"  # the lowest bit of each byte
    fold = lambda x, n: f"({x} | shiftrightunsigned({x}, {n}))"
    differ = " + ".join(f"bit_count({fold(fold(fold(f'(a_{w} ^ b_{w})', 4), 2), 1)} & {ones})" for w in LANES)
    return F.expr(f"{BINS} - ({differ}) >= {least_rows(threshold)}")


def bitmap_of(ids: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """A bitmap of 64-bit hashes modulo ``bits``, in rows of 512 words: never more than bits / 8 bytes."""
    place = F.pmod(F.col(column), F.lit(bits))
    rows = ids.select(F.floor(place / 32768).cast("int").alias("_row"), (place % 32768).alias("_bit")).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    words = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("_bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    return rows.select("_row", words.alias("_words"))


def maybe_in(rows: DataFrame, column: str, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows whose hash may be in the bitmap: all that are, and as few others as it has room for. It saves
    shuffling what a join would drop; it is small enough to broadcast whatever it was made of."""
    place = F.pmod(F.col(column), F.lit(bits))
    met = rows.withColumn("_row", F.floor(place / 32768).cast("int")).join(F.broadcast(bitmap), "_row")
    bit = place % 32768
    # of the eight bytes of a word the first is the highest
    within = (7 - F.floor(bit % 64 / 8)) * 8 + bit % 8
    return met.where(F.getbit(F.get("_words", F.floor(bit / 64).cast("int")), within.cast("int")) == 1).select(*rows.columns)


def bucket_members(signed: DataFrame, threshold: float) -> DataFrame:
    """``key, band, line_id, leader, n, near, w0..``: the lines of each bucket of two or more, for each band, and whether
    they agree with the bucket's leader in enough rows. The leader is the least line, so lines that are alike have the
    same leader in most bands."""
    keyed = signed.select("line_id", *LANES, F.posexplode("keys").alias("band", "key"))
    leaders = cut(keyed.groupBy("key").agg(F.min("line_id").alias("leader"), F.count("*").alias("n")).where("n > 1"))
    led = maybe_in(signed.select(F.col("line_id").alias("leader"), *(F.col(w).alias(f"a_{w}") for w in LANES)), "leader", bitmap_of(leaders, "leader"))
    own = maybe_in(keyed, "key", bitmap_of(leaders, "key")).withColumnsRenamed({w: f"b_{w}" for w in LANES})
    met = own.join(leaders.join(led, "leader"), "key")
    return met.select("key", "band", "line_id", "leader", "n", rows_agree(threshold).alias("near"), *(F.col(f"b_{w}").alias(w) for w in LANES))


def leader_pairs(members: DataFrame) -> DataFrame:
    """``a, b`` (a < b): each line with the leaders of its buckets that it agrees with in enough rows."""
    return members.where("near and line_id <> leader").select(F.col("leader").alias("a"), F.col("line_id").alias("b")).distinct()


def first_band() -> Column:
    """Whether no band before this one has the rows of ``a_`` and ``b_`` alike: in such a band's bucket the pair has come
    up already, or one of them leads it."""
    half = lambda k: f"(shiftrightunsigned(a_{LANES[k // 2]} ^ b_{LANES[k // 2]}, {32 * (k % 2)}) & 4294967295) <> 0"
    return F.expr(" and ".join(f"(band <= {k} or {half(k)})" for k in range(BANDS - 1)))


def other_pairs(members: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` (a < b): the pairs of a bucket without its leader that ``found(node, component)`` leaves apart and that
    agree in enough rows."""
    others = members.where("n > 2 and line_id <> leader").join(found.withColumnRenamed("node", "line_id"), "line_id", "left").withColumn("component", F.coalesce("component", "line_id"))
    split = others.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    others = others.join(split.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key")
    dealt = cut(others.withColumn("block", F.pmod(F.xxhash64("line_id"), F.col("blocks")).cast("int")).drop("leader", "n", "near"))
    values = ["line_id", "component", *LANES]
    one = dealt.select("key", "band", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), *(F.col(c).alias(f"a_{c}") for c in values))
    two = dealt.select("key", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), *(F.col(c).alias(f"b_{c}") for c in values))
    met = one.join(two, ["key", "i", "j"]).where(F.expr("(i < j or a_line_id < b_line_id) and a_component <> b_component") & rows_agree(threshold) & first_band())
    return met.select(F.least("a_line_id", "b_line_id").alias("a"), F.greatest("a_line_id", "b_line_id").alias("b")).distinct()


def shingle_hashes(line: str, size: int) -> Column:
    """Shingle hashes of a line. The two-byte form is a lambda's argument, so it is made once a line."""
    hashes = lambda w: F.transform(starts(F.octet_length(w), size), lambda i: F.xxhash64(F.substring(w, i, F.lit(2 * size))))
    return F.element_at(F.transform(F.array(wide(line)), hashes), 1)


def texts_of(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """``line_id, line`` of the distinct ``ids``. (A semi join would be moved below the bitmap's.)"""
    some = maybe_in(rows.select("line_id", "line"), "line_id", bitmap_of(ids, "line_id"))
    return some.join(ids, "line_id").dropDuplicates(["line_id"])


def verified(pairs: DataFrame, rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard index of ``threshold`` or more."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("line_id")).distinct())
    texts = cut(texts_of(wanted, rows))
    both = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("line").alias("s")), "a").join(texts.select(F.col("line_id").alias("b"), F.col("line").alias("t")), "b")
    # a filter isn't moved below an explode, so the hashes are made once a pair; each set operation stands once
    pair = both.select("a", "b", F.explode(F.array(F.struct(shingle_hashes("s", size).alias("s"), shingle_hashes("t", size).alias("t")))).alias("p"))
    return pair.where(F.size(F.array_intersect("p.s", "p.t")) >= threshold * F.size(F.array_union("p.s", "p.t")) - 1e-9).select("a", "b")


def line_components(docs: DataFrame, size: int = SIZE, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, line_no, line_id, component_id, kept, version`` of all lines that aren't blank."""
    rows = lines(docs, id_col, text_col)
    signed = cut(signatures(rows, size))
    members = cut(bucket_members(signed, threshold))
    edges = verified(cut(leader_pairs(members)), rows, size, threshold)
    led = cut(components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    others = verified(cut(other_pairs(members, led, threshold)), rows, size, threshold)
    links = led.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(others.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    found = components(links).withColumnRenamed("node", "line_id")
    place = F.struct(id_col, "version", "line_no")
    every = rows.select(id_col, "version", "line_no", "line_id")
    # the first place of each distinct line, then of each component among the lines that have one
    first = every.groupBy("line_id").agg(F.min(place).alias("own"))
    shared = cut(found.join(first, "line_id"))
    best = shared.groupBy("component").agg(F.min("own").alias("best"))
    shared = shared.join(best, "component").select("line_id", "component", "best")
    places = first.join(shared, "line_id", "left").select("line_id", F.coalesce("component", "line_id").alias("component_id"), F.coalesce("best", "own").alias("stays"))
    return every.join(places, "line_id").select(id_col, "line_no", "line_id", "component_id", (place == F.col("stays")).alias("kept"), "version")


def dedup(docs: DataFrame, size: int = SIZE, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; a document all of whose lines do goes.

    The other columns stay, whatever their names; ``n_chars``, where there is one, is counted anew for texts that
    changed.
    """
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"))
    gone = line_components(docs, size, threshold).where("not kept").groupBy(F.col("doc_id").alias("id"), "version").agg(F.collect_set("line_no").alias("gone"))
    # numbers of the lines that stay, by one hash set; parts and numbers are a lambda's argument, so they are made once
    parts = F.split(F.col("doc.text"), "\n", -1)
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone"))
    left = F.element_at(F.transform(F.array(F.struct(parts.alias("parts"), stay.alias("stay"))), lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["parts"], i)), "\n")), 1)
    changed = F.col("gone").isNotNull()
    cleaned = whole.join(gone, ["id", "version"], "left").withColumn("left", F.when(changed, left))
    kept = cleaned.where(~changed | (F.trim(F.regexp_replace("left", "\n", "")) != ""))
    out = {"text": F.coalesce("left", "doc.text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return kept.select(*(out.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
