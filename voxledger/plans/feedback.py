"""Queries of the feedback taxonomy and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxledger.functions import text as T
from voxledger.operators import cosine as C
from voxledger.operators import evaluate as E
from voxledger.operators import ledger as L
from voxledger.operators import phrases as P
from voxledger.operators import precedents as G
from voxledger.operators import reviews as R
from voxledger.operators import simjoin as S
from voxledger.plans.bindings import GATE_LABELS_SQL, LEDGER_SQL, MANIFEST_SQL, PHRASES_SQL, REVIEWS_SQL, gate_labels, ledger, manifest, phrases, quoted, reviews, sql_list, sql_norm, table
from voxledger.sources.readers import mapped_products

LED = f"WITH {LEDGER_SQL}, counted AS (SELECT canonical_id, product, count(DISTINCT review_id) AS votes FROM votes WHERE review_id <> '' GROUP BY ALL) "
REV = f"WITH {REVIEWS_SQL} "
PHR = f"WITH {PHRASES_SQL}, normed AS (SELECT *, {sql_norm('quote')} AS norm FROM phrases) "
LAB = f"WITH {GATE_LABELS_SQL} "
PRODUCTS = [f"src{i}" for i in range(20)]
BUCKETS = [("en", "English"), ("fr", "French")]

# SQL of the text kernel, on a column ``prep`` of prepared words
STEM_ONCE = "CASE " + " ".join(f"WHEN ends_with(a, '{x}') AND length(a) - {len(x)} >= 3 THEN left(a, length(a) - {len(x)})" for x in T.SUFFIXES) + " ELSE a END"


def sql_stem(w: str) -> str:
    stripped = f"list_reduce([{w}, '', '', '', '', '', '', '', '', ''], lambda a, b: {STEM_ONCE})"
    return f"list_transform([{stripped}], lambda s: CASE WHEN length(s) > 3 AND right(s, 1) = left(right(s, 2), 1) THEN left(s, length(s) - 1) ELSE s END)[1]"


def sql_tokens(column: str, without: list[str]) -> str:
    return f"list_distinct(list_transform(list_filter(string_split({column}, ' '), lambda w: w <> '' AND NOT list_contains({sql_list(without)}, w)), lambda w: {sql_stem('w')}))"


def sql_grams(column: str) -> str:
    return f"list_distinct(list_transform(generate_series(1, length({column})), lambda i: substr(' ' || {column} || ' ', i, 3)))"


def sql_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def names(spark, sf_dir):
    """Group names of every category, with their token and trigram sets."""
    groups, _, _ = ledger(spark, sf_dir)
    return S.profiled(groups.select(F.col("group_id").alias("id"), "category", F.col("name").alias("text"), "ord"))


def name_pairs(threshold):
    def query(spark, sf_dir):
        items = names(spark, sf_dir)
        return S.lexical_join(items, items, threshold, itself=False)

    return query


def nearest_names(spark, sf_dir):
    items = names(spark, sf_dir)
    return S.nearest(items, items, S.lexical_join(items, items, 0.3, itself=False).withColumn("sim", F.round("sim", 9)))


def name_pairs_sql(threshold: float) -> str:
    return (
        LED
        + f""", items AS (SELECT group_id AS id, category, ord, {sql_tokens("name", T.STOPWORDS)} AS toks, {sql_grams("name")} AS grams FROM groups),
        parts AS (SELECT DISTINCT id, category, unnest(list_concat(list_transform(toks, lambda x: 't' || x), list_transform(grams, lambda x: 'g' || x))) AS part FROM items),
        met AS (SELECT DISTINCT a.id AS a, b.id AS b FROM parts a JOIN parts b USING (category, part) WHERE a.id <> b.id),
        pairs AS (SELECT l.id AS l, r.id AS r, l.category, 0.6 * ({sql_jaccard("l.toks", "r.toks")}) + 0.4 * ({sql_jaccard("l.grams", "r.grams")}) AS sim FROM met JOIN items l ON l.id = met.a JOIN items r ON r.id = met.b),
        near AS (SELECT * FROM pairs WHERE sim >= {threshold}) """
    )


def near_sql(phrase: str, into: str) -> str:
    """The nearest labelled pair of each gate label, among the labels of even time."""
    return f"""profs AS (SELECT t, {sql_tokens("t", T.STOPWORDS)} AS toks, {sql_grams("t")} AS grams FROM (SELECT phrase AS t FROM gate_labels UNION SELECT into_ FROM gate_labels)),
        close AS (SELECT * FROM (SELECT l.t AS l, r.t AS r, 0.6 * ({sql_jaccard("l.toks", "r.toks")}) + 0.4 * ({sql_jaccard("l.grams", "r.grams")}) AS sim FROM profs l JOIN profs r ON true) WHERE sim >= 0.75),
        half AS (SELECT * FROM gate_labels WHERE ts % 2 = 0), ruled AS (SELECT * FROM half WHERE reason IS NOT NULL),
        cand AS ({" UNION ALL ".join(f"SELECT p.ts AS id, k.label, k.ts, round(least(s1.sim, s2.sim), 9) AS score FROM gate_labels p JOIN ruled k ON p.category = k.category AND p.reason = k.reason JOIN close s1 ON s1.l = p.{phrase} AND s1.r = k.{a} JOIN close s2 ON s2.l = p.{into} AND s2.r = k.{b}" for a, b in (("phrase", "into_"), ("into_", "phrase")))}),
        nearest AS (SELECT id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ts) AS n FROM cand) WHERE n = 1)"""


def exports(spark, sf_dir):
    """Conversations in the layout of a review export: one file each, a block per turn."""
    block = F.format_string("%s %s out of 5 stars Turn %s Reviewed in the United States on %s %s, 2024 Verified Purchase %s Helpful Report ", F.col("role"), (F.col("turn") % 5 + 1).cast("string"), F.col("turn").cast("string"), F.element_at(F.array(*map(F.lit, ("March", "June"))), (F.col("turn") % 2 + 1).cast("int")), (F.col("conv_id") % 28 + 1).cast("string"), F.regexp_replace("text", r"(?U)[^\w .,]", " "))
    rows = table(spark, sf_dir, "conversations").withColumn("b", F.struct("turn", block.alias("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["t"]), "")
    return rows.groupBy("conv_id").agg(F.concat(F.lit("Example.com Customer reviews 4.3 out of 5 stars 120 global ratings "), text).alias("raw_text")).select(F.col("conv_id").cast("string").alias("file_stem"), "raw_text")


def related(spark, sf_dir):
    """Phrases with relation and gist; in one of the categories, which is keyed by relation, one in three has none."""
    relation = F.when(F.col("phrase_seq") % 3 == 0, "").otherwise(F.concat(F.lit("Relation "), F.split("quote", " ")[0]))
    return phrases(spark, sf_dir).withColumns({"relation": relation, "gist": F.concat(F.lit("Gist "), F.substring("quote", 1, 12))})


RELATED_SQL = f"""related AS (SELECT *, CASE WHEN phrase_seq % 3 = 0 THEN '' ELSE 'Relation ' || string_split(quote, ' ')[1] END AS relation, 'Gist ' || substr(quote, 1, 12) AS gist FROM phrases),
    keyed AS (SELECT *, CASE WHEN category = 'es' AND relation <> '' THEN relation ELSE quote END AS key_text FROM related), normed AS (SELECT *, {sql_norm("key_text")} AS norm FROM keyed)"""


def status(spark, sf_dir):
    """Folder status by category: reviews and taxonomy of its language, reports among the pages."""
    groups, canonicals, _ = ledger(spark, sf_dir)
    lines = F.element_at(F.array(*map(F.lit, ("en", "fr", "xx"))), (F.col("object_key") % 3 + 1).cast("int"))
    reports = manifest(spark, sf_dir).select(lines.alias("product_line"), F.concat(F.lit("report-"), F.lpad(F.col("object_key").cast("string"), 9, "0")).alias("name"))
    rows = canonicals.join(groups.select("group_id", "category"), "group_id")
    return L.folder_status(reviews(spark, sf_dir).withColumnRenamed("author", "product_line"), groups.withColumnRenamed("category", "product_line"), rows.withColumnRenamed("category", "product_line"), reports)


def products(spark, sf_dir):
    """Every export file's product by a mapping table, files of one source being one product."""
    stems = reviews(spark, sf_dir).select(F.col("stem").alias("file_stem"), F.col("file").alias("name"))
    mapping = stems.distinct().withColumn("link", F.concat(F.lit("https://shop.example/"), F.lower("name")))
    return L.products_sheet(mapped_products(stems, mapping, F.col("file_stem")))


HEADER, FOOTER = "Quote what customers say, by category:\n", "Quote word for word."
CATEGORIES = [(1, "en", "what is praised."), (2, "fr", " "), (3, "de", None)]


def requests(spark, sf_dir):
    r = reviews(spark, sf_dir).withColumn("product", F.col("stem"))
    line = F.concat(F.lit("rating="), (F.col("seq") % 5 + 1).cast("string"), F.lit(" | title: "), F.coalesce("author", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    system = P.instructions(spark.createDataFrame(CATEGORIES, "position int, category string, extract_rule string"), HEADER, FOOTER)
    return P.rendered(P.request_batches(r), ("file", "run", "batch"), "seq", line, system)


def answers(spark, sf_dir):
    """A judge's loose answers: an object in prose and a code fence, with indexes, categories and quotes that don't count."""
    quote = lambda i, q, *c: F.struct(F.lit(i).alias("index"), q.cast("string").alias("quote"), F.array(*c).alias("categories"))
    told = F.struct(F.array(quote(1, F.substring("body", 1, 40), F.col("author"), F.lit("none")), quote(9, F.col("file"), F.col("author")), quote(2, F.lit("  "), F.lit("en")), quote(2, F.col("file"), F.col("author"), F.lit("en"))).alias("quotes"))
    raw = reviews(spark, sf_dir).select(F.col("review_id").alias("batch_key"), F.lit(2).alias("n_reviews"), F.concat(F.lit("Here it is:\n```json\n"), F.to_json(told), F.lit("\n```\nAnything else?")).alias("response_text"))
    return P.answered(raw, spark.createDataFrame([("en",), ("fr",), ("de",)], "category string"))


def on_ledger(f):
    return lambda spark, sf_dir: f(*ledger(spark, sf_dir))


def on_mentions(f):
    """On the ledger with its repeats, for operators that read votes once and count distinct reviews; who reads them twice
    reads the shuffle that takes repeats out."""
    return lambda spark, sf_dir: f(*ledger(spark, sf_dir, repeats=True))


def on_phrases(f):
    return lambda spark, sf_dir: f(phrases(spark, sf_dir))


def on_reviews(f):
    return lambda spark, sf_dir: f(reviews(spark, sf_dir))


def on_labels(f):
    return lambda spark, sf_dir: f(gate_labels(spark, sf_dir))


def gold(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("gold"), (F.col("vec_id") % 7).cast("int").alias("predicted"))


def scored(spark, sf_dir):
    """Scored pairs: event values scaled to -0.2 .. 1, the same message where the event isn't an error."""
    return table(spark, sf_dir, "events").select((F.floor(F.col("value")) % 120 / 100.0 - 0.2).alias("score"), (F.col("event_type") != "error").alias("same"))


def merges(canonicals):
    """Rows of a group merged into its first one."""
    keep = canonicals.groupBy("group_id").agg(F.min_by("canonical_id", "ord").alias("keep_id"))
    return canonicals.join(keep, "group_id").where("canonical_id <> keep_id").select(F.col("canonical_id").alias("merge_id"), "keep_id")


def sheet(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("sheet"), d.alias("row_no"), F.when(d % 60 < 20, F.concat(F.lit("g"), (d % 13).cast("string"))).alias("group"), F.when(d % 17 != 0, F.col("text")).alias("text"), F.when(d % 3 == 0, (d % 15).cast("int")).alias("votes"))


SHEET_SQL = "sheet AS (SELECT source AS sheet, doc_id AS row_no, CASE WHEN doc_id % 60 < 20 THEN 'g' || CAST(doc_id % 13 AS VARCHAR) END AS grp, CASE WHEN doc_id % 17 <> 0 THEN text END AS text, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 15 AS INTEGER) END AS votes FROM documents), gold AS (SELECT sheet, row_no, last_value(grp IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS \"group\", text, coalesce(votes, 1) AS votes FROM sheet), kept AS (SELECT * FROM gold WHERE text IS NOT NULL AND trim(text) <> '')"


def cosine_items(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("category"), F.col("embedding").alias("v"))


QUERIES = {
    "p7_product_key": on_reviews(lambda r: r.select("review_id", T.product_key(F.col("stem")).alias("product"))),
    "p8_remapped_ledger": on_mentions(lambda g, c, v: L.counted(L.remapped(v, F.regexp_replace("product", "[0-9]$", "")))),
    "p8_renamed_cells": on_mentions(lambda g, c, v: L.renamed_cells(v, F.regexp_replace("product", "[0-9]$", ""))),
    "p9_renames": on_reviews(lambda r: L.renames(r.select(F.col("stem").alias("old"), T.product_key(F.col("stem")).alias("new")))),
    "p10_cutoff": on_reviews(lambda r: R.newest(r, "2024-06-01").select("review_id", "review_date", "place")),
    "p12_search": on_mentions(lambda g, c, v: L.search(c, v, "The")),
    "p13_product_view": on_mentions(lambda g, c, v: L.product_view(c, v, "src1", 1)),
    "p15_singletons": on_mentions(lambda g, c, v: L.singletons(c, v)),
    "j1_with_review": lambda s, d: P.with_review(phrases(s, d), reviews(s, d)).select("review_id", "phrase_seq", F.length("body").alias("body_length")),
    "j2_exact_placement": lambda s, d: P.placed_exactly(P.unique_phrases(phrases(s, d)), ledger(s, d)[1].withColumn("category", F.split("canonical_id", r"\|")[0])).select("category", "norm", "product", "n", "canonical_id"),
    "j3_lexical_join": lambda s, d: name_pairs(0.5)(s, d).select("l", "r", F.round("sim", 6).alias("sim")),
    "j5_lexical_shortlist": lambda s, d: S.shortlist(name_pairs(0.3)(s, d).withColumn("sim", F.round("sim", 9)), 5).select("l", "r", "rank"),
    "j6_cosine_shortlist": lambda s, d: C.cosine_shortlist(cosine_items(s, d), cosine_items(s, d)),
    "j7_nearest_row": nearest_names,
    "j8_new_group_suspects": lambda s, d: name_pairs(0.25)(s, d).select("l").distinct(),
    "j9_contained_phrases": on_phrases(P.contained),
    "j10_uncached_requests": on_reviews(lambda r: P.uncached(P.cache_key(r, ("author", "body")), P.first_written(P.cache_key(r.where("seq % 2 = 0"), ("author", "body")).select("cache_key", F.col("body").alias("response_text"), "seq"))).select("review_id")),
    "j11_exact_precedents": on_labels(G.exact_precedents),
    "j12_near_precedents": on_labels(lambda x: G.near_precedents(x.select(F.col("ts").alias("id"), "category", "reason", "phrase", "into"), x.where("ts % 2 = 0"))),
    "j13_variant_counts": lambda s, d: L.variant_counts(*ledger(s, d)[1:], phrases(s, d)),
    "j15_override_targets": lambda s, d: L.by_name(phrases(s, d).select(F.split("quote", " ")[0].alias("wanted")).distinct(), ledger(s, d)[0], "name", "group_id"),
    "t8_relocated_rows": on_mentions(lambda g, c, v: L.counted(L.relocated(c, v, g.where("length(name) > 6").join(g.groupBy("category").agg(F.min_by("group_id", "ord").alias("to_group")), "category").select("group_id", "to_group"))[1])),
    "f15_lost_contexts": lambda s, d: R.lost_contexts(exports(s, d).withColumn("raw_text", F.replace("raw_text", F.lit("3 out of 5"), F.lit("3 ou t of 5")))),
    "f18_requests": requests,
    "p11_answered": answers,
    "a8_unique_phrases": lambda s, d: P.unique_phrases(related(s, d), ("es",)),
    "a8_unique_pairs": lambda s, d: P.unique_pairs(related(s, d), ("es",)),
    "a9_votes": on_mentions(lambda g, c, v: L.counted(v)),
    "a9_reconciled": on_ledger(lambda g, c, v: L.reconciled(v.groupBy("canonical_id", "product").agg((F.count("*") + 2).alias("votes")), v)),
    "a10_totals": on_mentions(L.totals),
    "a11_matrix": on_mentions(lambda g, c, v: L.matrix(v, PRODUCTS)),
    "a12_two_level_report": on_mentions(L.two_level),
    "a13_relation_report": lambda s, d: L.relation_report(*ledger(s, d, repeats=True), s.createDataFrame(BUCKETS, "category string, label string")),
    "a14_wish_report": on_ledger(lambda g, c, v: L.wish_report(c, v)),
    "a15_products": products,
    "a16_rule_weights": on_labels(G.rule_weights),
    "a17_soft_rules": on_labels(lambda x: G.soft_rules(G.rule_weights(x), 3, 0.1)),
    "a22_folder_status": status,
    "a23_parse_stats": lambda s, d: R.parse_stats(exports(s, d)),
    "a24_queue_counts": lambda s, d: G.queue_counts(gate_labels(s, d).select(F.concat(F.lit("type"), (F.col("ts") % 8).cast("string")).alias("type"), "category", "phrase", "into"), gate_labels(s, d).where("label = 'merge'")),
    "k1_verdicts": on_labels(lambda x: G.verdicts(x.select("category", F.col("into").alias("phrase"), F.col("phrase").alias("into"), "reason", "ts"), x.where("ts % 2 = 0"))),
    "k2_captured_labels": on_labels(lambda x: G.captured(x.select(G.label_key(F.col("category"), F.col("phrase"), F.col("into")).alias("key"), F.when(F.col("ts") % 6 == 0, "undo").otherwise(F.col("label")).alias("label"), "ts"))),
    "u1_review_union": lambda s, d: reviews(s, d).where("seq % 2 = 0").unionByName(reviews(s, d).where("seq % 2 = 1")).groupBy("file").agg(F.count("*").alias("n")),
    "u3_set_operations": on_phrases(lambda p: p.select("phrase_seq", F.split(F.lower("quote"), " ").alias("w"), F.split(F.lower("product"), "").alias("x")).select("phrase_seq", F.size(F.array_union("w", "x")).alias("either"), F.size(F.array_intersect("w", "x")).alias("both"), F.size(F.array_except("w", "x")).alias("only"))),
    "u4_distinct_records": on_labels(lambda x: G.distinct_records(x.select("category", "phrase", "reason", "label", "ts"), "ts")),
    "u5_training_pairs": on_labels(lambda x: E.training_pairs(x.where("ts % 2 = 0").select(F.col("phrase").alias("a"), F.col("into").alias("b"), "label"), x.where("ts % 2 = 1").select(F.col("into").alias("a"), F.col("phrase").alias("b"), "label"))),
    "w1_review_dedup": on_reviews(lambda r: R.deduplicated(r).select("review_id", "file")),
    "w2_newest_reviews": on_reviews(lambda r: R.newest(R.deduplicated(r), "2024-03-01", 20).select("review_id", "file", "place")),
    "w4_request_batches": on_reviews(lambda r: P.request_batches(r.withColumn("product", F.col("stem"))).select("review_id", "run", "batch")),
    "w5_phrase_batches": on_phrases(lambda p: P.chunked(p, "category", "phrase_seq", 25).select("phrase_seq", "chunk")),
    "w6_row_budget": on_ledger(lambda g, c, v: P.budgeted(c.groupBy("group_id").agg(F.count("*").alias("n_rows"), F.min("ord").alias("ord")).withColumn("category", F.split("group_id", r"\|")[0]).withColumn("total", F.col("n_rows") * 3)).select("group_id", "call")),
    "w7_context": on_mentions(L.context),
    "w11_gold_rows": lambda s, d: E.gold_rows(sheet(s, d)),
    "w12_stratified": lambda s, d: E.stratified(E.gold_rows(sheet(s, d)), 3).select("row_no", "group"),
    "c1_replicated": lambda s, d: E.replicated(E.gold_rows(sheet(s, d))).select("row_no", "copy"),
    "c2_predicted": on_labels(lambda x: E.predicted_groups(x.select(F.col("phrase").alias("text"), F.col("into").alias("group"), F.col("ts").alias("ord")))),
    "c3_pairwise": lambda s, d: E.pairwise(gold(s, d)),
    "c4_wrong_pairs": lambda s, d: E.wrong_pairs(gold(s, d)),
    "c5_over_merged": lambda s, d: E.over_merged(gold(s, d).select(F.col("predicted").alias("canonical"), (F.col("id") % 3).alias("product"), "gold")),
    "c6_sweep": lambda s, d: E.sweep(scored(s, d)),
    "f1_normalized": on_reviews(lambda r: r.select("review_id", T.normalize(F.col("body")).alias("norm"))),
    "f2_prepared": on_phrases(lambda p: p.select("phrase_seq", T.prepare(F.col("quote")).alias("prepared"))),
    "f4_tokens": on_phrases(lambda p: p.select("phrase_seq", F.array_sort(T.tokens(T.prepare(F.col("quote")))).alias("toks"), F.array_sort(T.content_tokens(T.prepare(F.col("quote")))).alias("content"))),
    "f5_trigrams": on_phrases(lambda p: p.select("phrase_seq", F.size(T.trigrams(T.prepare(F.col("quote")))).alias("n"))),
    "f13_segmented_reviews": lambda s, d: R.parsed(exports(s, d)),
    "f14_parsed_date": on_reviews(lambda r: r.select("review_id", R.parsed_date(F.when(F.col("seq") % 7 == 0, "Smarch 1, 2024").otherwise(F.date_format("review_date", "MMMM d, yyyy"))).alias("d"))),
    "f22_quote_variants": on_ledger(lambda g, c, v: L.wish_report(c, v, 3).select("canonical_id", "product", F.array_distinct(F.filter(F.transform(F.split("quotes", "; "), lambda q: F.trim(q)), lambda q: q != "")).alias("variants"))),
    "f23_label_key": on_labels(lambda x: x.select("ts", G.label_key(F.col("category"), F.col("phrase"), F.col("into")).alias("key"))),
    "s8_load_taxonomy": on_mentions(lambda g, c, v: L.counted(v).join(c, "canonical_id").join(g.select("group_id", "category", "name"), "group_id").select("group_id", "canonical_id", "category", "name", "text", "product", "votes")),
    "s9_taxonomy_counts": on_ledger(lambda g, c, v: g.agg(F.count("*").alias("groups")).crossJoin(c.agg(F.count("*").alias("canonicals")))),
    "t7_merged_canonicals": on_mentions(lambda g, c, v: L.counted(L.merged(v, merges(c)))),
    "t12_pruned_rows": on_ledger(lambda g, c, v: L.dropped(c, v.where("length(quote) > 20")).select("canonical_id")),
}
CELLS = "cells AS (SELECT c.group_id, c.canonical_id, g.category, g.name, c.text, t.product, t.votes, c.ord FROM counted t JOIN canonicals c USING (canonical_id) JOIN groups g ON g.group_id = c.group_id)"
WISH = "q AS (SELECT canonical_id, product, quote, row_number() OVER (PARTITION BY canonical_id, product ORDER BY min(review_id), quote) AS n FROM votes GROUP BY canonical_id, product, quote)"
ORACLES = {
    "p7_product_key": REV + "SELECT review_id, file AS product FROM reviews",
    "p8_remapped_ledger": LED + "SELECT canonical_id, regexp_replace(product, '[0-9]$', '') AS product, count(DISTINCT review_id) AS votes FROM votes GROUP BY ALL",
    "p9_renames": REV + "SELECT DISTINCT stem AS old, file AS new FROM reviews",
    "p10_cutoff": REV + "SELECT review_id, review_date, row_number() OVER (PARTITION BY file ORDER BY review_date DESC NULLS LAST, seq) AS place FROM reviews WHERE review_date IS NULL OR review_date >= DATE '2024-06-01'",
    "p12_search": LED + "SELECT c.canonical_id, text, CAST(coalesce(v, 0) AS BIGINT) AS votes FROM canonicals c LEFT JOIN (SELECT canonical_id, sum(votes) AS v FROM counted GROUP BY 1) t USING (canonical_id) WHERE contains(text, 'the')",
    "p13_product_view": LED + f", {CELLS} SELECT canonical_id, product, votes, group_id, CAST(sum(votes) OVER (PARTITION BY group_id) AS BIGINT) AS group_votes, row_number() OVER (PARTITION BY group_id ORDER BY votes DESC, ord) AS row_place FROM cells WHERE product = 'src1'",
    "p15_singletons": LED + "SELECT group_id, count(*) AS rows, CAST(coalesce(sum(v), 0) AS BIGINT) AS votes FROM canonicals LEFT JOIN (SELECT canonical_id, sum(votes) AS v FROM counted GROUP BY 1) USING (canonical_id) GROUP BY group_id HAVING count(*) = 1 AND coalesce(sum(v), 0) <= 2",
    "j1_with_review": f"WITH {PHRASES_SQL}, {REVIEWS_SQL} SELECT review_id, phrase_seq, CAST(length(body) AS INTEGER) AS body_length FROM phrases LEFT JOIN reviews USING (review_id)",
    "j2_exact_placement": LED + "SELECT category, text AS norm, product, count(*) AS n, category || '|' || text AS canonical_id FROM named GROUP BY ALL",
    "j3_lexical_join": name_pairs_sql(0.5) + "SELECT l, r, round(sim, 6) AS sim FROM near",
    "j5_lexical_shortlist": name_pairs_sql(0.3) + "SELECT l, r, rank FROM (SELECT l, r, row_number() OVER (PARTITION BY l ORDER BY round(sim, 9) DESC, r) AS rank FROM near) WHERE rank <= 5",
    "j6_cosine_shortlist": "WITH p AS (SELECT a.vec_id AS l, b.vec_id AS r, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT l, r, rank FROM (SELECT l, r, row_number() OVER (PARTITION BY l ORDER BY sim DESC, r) AS rank FROM p WHERE sim >= 0.35) WHERE rank <= 3",
    "j7_nearest_row": name_pairs_sql(0.3) + "SELECT i.id, coalesce(b.r, f.first) AS nearest FROM items i LEFT JOIN (SELECT l, r FROM (SELECT l, r, row_number() OVER (PARTITION BY l ORDER BY round(sim, 9) DESC, r) AS k FROM near) WHERE k = 1) b ON i.id = b.l LEFT JOIN (SELECT category, arg_min(id, ord) AS first FROM items GROUP BY 1) f ON i.category = f.category",
    "j8_new_group_suspects": name_pairs_sql(0.25) + "SELECT DISTINCT l FROM near",
    "j9_contained_phrases": PHR + ", w AS (SELECT *, array_to_string(regexp_extract_all(lower(quote), '[\\p{L}\\p{N}_]+'), ' ') AS w FROM phrases) SELECT a.phrase_seq AS a, b.phrase_seq AS b FROM w a JOIN w b ON a.product = b.product AND a.review_id = b.review_id AND a.category = b.category WHERE a.phrase_seq <> b.phrase_seq AND a.w <> '' AND len(string_split(a.w, ' ')) < len(string_split(b.w, ' ')) AND contains(' ' || b.w || ' ', ' ' || a.w || ' ')",
    "j10_uncached_requests": REV + "SELECT review_id FROM reviews WHERE NOT EXISTS (SELECT 1 FROM reviews c WHERE c.seq % 2 = 0 AND c.author = reviews.author AND c.body = reviews.body)",
    "j13_variant_counts": LED + f""", said AS (SELECT product, text AS norm, count(*) AS n FROM norm GROUP BY ALL), q AS (SELECT DISTINCT canonical_id, product, {sql_norm("quote")} AS norm FROM votes)
        SELECT q.canonical_id, q.product, q.norm, coalesce(s.n, 1) AS n, q.norm = c.text AS is_own, t.votes, sum(coalesce(s.n, 1)) OVER (PARTITION BY q.canonical_id, q.product) < t.votes AS gap
        FROM q LEFT JOIN said s ON s.product = q.product AND s.norm = q.norm JOIN canonicals c ON c.canonical_id = q.canonical_id JOIN counted t ON t.canonical_id = q.canonical_id AND t.product = q.product""",
    "j15_override_targets": LED + f""", w AS (SELECT DISTINCT string_split(quote, ' ')[1] AS wanted FROM phrases), f AS (SELECT name, arg_min(group_id, ord) AS group_id FROM groups GROUP BY name)
        SELECT wanted, group_id, group_id IS NOT NULL AS valid FROM w LEFT JOIN f ON name = {sql_norm("wanted")}""",
    "t8_relocated_rows": LED + """, home AS (SELECT category, arg_min(group_id, ord) AS h FROM groups GROUP BY category), placed AS (SELECT canonical_id, text, c.ord, CASE WHEN length(g.name) > 6 THEN h ELSE g.group_id END AS grp FROM canonicals c JOIN groups g ON g.group_id = c.group_id JOIN home USING (category)),
        kept AS (SELECT canonical_id, first_value(canonical_id) OVER (PARTITION BY grp, text ORDER BY ord) AS keep FROM placed) SELECT keep AS canonical_id, product, count(DISTINCT review_id) AS votes FROM votes JOIN kept USING (canonical_id) GROUP BY ALL""",
    "j11_exact_precedents": LAB + "SELECT category, a, b, arg_max(label, ts * 2 + o) AS label FROM (SELECT category, phrase AS a, into_ AS b, label, ts, 0 AS o FROM gate_labels UNION ALL SELECT category, into_, phrase, label, ts, 1 FROM gate_labels) GROUP BY ALL",
    "a8_unique_phrases": f"WITH {PHRASES_SQL}, {RELATED_SQL} SELECT category, norm, product, n, quotes, reviews, CAST(sum(n) OVER w AS BIGINT) AS total, first_value(q) OVER f AS text, first_value(rel) OVER f AS relation, first_value(g) OVER f AS gist, min(s) OVER w AS first_seq FROM (SELECT category, norm, product, count(*) AS n, count(DISTINCT quote) AS quotes, count(DISTINCT review_id) AS reviews, arg_min(trim(key_text), phrase_seq) AS q, arg_min(relation, phrase_seq) AS rel, arg_min(gist, phrase_seq) AS g, min(phrase_seq) AS s FROM normed GROUP BY ALL) WINDOW w AS (PARTITION BY category, norm), f AS (PARTITION BY category, norm ORDER BY s)",
    "a8_unique_pairs": f"WITH {PHRASES_SQL}, {RELATED_SQL} SELECT DISTINCT category, norm, product, review_id, quote FROM normed",
    "a9_votes": LED + "SELECT * FROM counted",
    "a9_reconciled": LED + "SELECT s.canonical_id, s.product, c.votes, greatest(s.votes - c.votes, 0) AS removed FROM (SELECT canonical_id, product, count(*) + 2 AS votes FROM votes GROUP BY ALL) s JOIN counted c ON s.canonical_id = c.canonical_id AND s.product = c.product",
    "a10_totals": LED + f", {CELLS} SELECT category, group_id, canonical_id, CAST(sum(votes) AS BIGINT) AS votes FROM cells GROUP BY ROLLUP (category, group_id, canonical_id)",
    "a11_matrix": LED + "SELECT canonical_id, " + ", ".join(f"CAST(coalesce(sum(votes) FILTER (product = '{p}'), 0) AS BIGINT) AS {p}" for p in PRODUCTS) + ", CAST(coalesce(sum(votes), 0) AS BIGINT) AS total FROM counted GROUP BY canonical_id",
    "a12_two_level_report": LED
    + f""", {CELLS}, s AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY group_id, product) AS BIGINT) AS subtotal, CAST(sum(votes) OVER (PARTITION BY group_id) AS BIGINT) AS group_total FROM cells)
        SELECT group_id, canonical_id, category, name, text, product, votes, subtotal, group_total, dense_rank() OVER (PARTITION BY category ORDER BY group_total DESC, name) AS group_place,
        dense_rank() OVER (PARTITION BY group_id ORDER BY subtotal DESC, product) AS product_place, row_number() OVER (PARTITION BY group_id, product ORDER BY votes DESC, ord) AS row_place FROM s""",
    "a13_relation_report": LED
    + f""", {CELLS}, r AS (SELECT coalesce(g.usage_category, b.label, 'Other') AS bucket, c.group_id, c.canonical_id, CAST(sum(c.votes) AS BIGINT) AS votes FROM cells c JOIN groups g ON g.group_id = c.group_id
        LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in BUCKETS)}) b(category, label) ON b.category = c.category GROUP BY ALL)
        SELECT *, CAST(sum(votes) OVER (PARTITION BY bucket, group_id) AS BIGINT) AS group_total, CAST(sum(votes) OVER (PARTITION BY bucket) AS BIGINT) AS bucket_total FROM r""",
    "a14_wish_report": LED + f", {CELLS}, {WISH} SELECT canonical_id, product, votes, quotes, group_id, text, CAST(sum(votes) OVER (PARTITION BY group_id) AS BIGINT) AS group_total FROM cells JOIN (SELECT canonical_id, product, string_agg(quote, '; ' ORDER BY n) AS quotes FROM q WHERE n <= 2 GROUP BY ALL) USING (canonical_id, product)",
    "a15_products": REV + "SELECT DISTINCT file AS name, 'https://shop.example/' || lower(file) AS link FROM reviews",
    "p8_renamed_cells": LED + "SELECT count(*) AS renamed FROM (SELECT DISTINCT canonical_id, product FROM votes WHERE regexp_replace(product, '[0-9]$', '') <> product)",
    "p11_answered": REV + "SELECT review_id AS batch_key, 2 AS n_reviews, 1 AS index, substr(body, 1, 40) AS quote, author AS category FROM reviews WHERE trim(substr(body, 1, 40)) <> '' AND author IN ('en', 'fr', 'de') UNION ALL SELECT review_id, 2, 2, file, author FROM reviews WHERE trim(file) <> '' AND author IN ('en', 'fr', 'de') UNION ALL SELECT review_id, 2, 2, file, 'en' FROM reviews WHERE trim(file) <> ''",
    "f13_segmented_reviews": r"""SELECT CAST(conv_id AS VARCHAR) AS file_stem, conv_id || ':' || n AS review_id, CASE WHEN n = 1 THEN '' ELSE role END AS author, CAST(turn % 5 + 1 AS DOUBLE) AS rating, 'Turn ' || turn AS title,
        make_date(2024, CASE WHEN turn % 2 = 0 THEN 3 ELSE 6 END, CAST(conv_id % 28 + 1 AS INTEGER)) AS review_date, '' AS variant, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{Pc} .,]', ' ', 'g'), ' +', ' ', 'g')) AS body
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)""",
    "a16_rule_weights": LAB + "SELECT reason, count(*) FILTER (label = 'keep') AS n_keep, count(*) FILTER (label = 'merge') AS n_merge FROM gate_labels WHERE reason IS NOT NULL GROUP BY reason",
    "a17_soft_rules": LAB + "SELECT *, n_keep + n_merge >= 3 AND n_merge >= 0.1 * (n_keep + n_merge) AS soft FROM (SELECT reason, count(*) FILTER (label = 'keep') AS n_keep, count(*) FILTER (label = 'merge') AS n_merge FROM gate_labels WHERE reason IS NOT NULL GROUP BY reason)",
    "a22_folder_status": f"WITH {LEDGER_SQL}, {REVIEWS_SQL}, {MANIFEST_SQL}, r AS (SELECT author AS product_line, count(DISTINCT stem) AS files, count(*) AS reviews FROM reviews GROUP BY 1), g AS (SELECT category AS product_line, count(*) AS groups FROM groups GROUP BY 1), c AS (SELECT string_split(canonical_id, '|')[1] AS product_line, count(*) AS phrases FROM canonicals GROUP BY 1), p AS (SELECT ['en', 'fr', 'xx'][CAST(object_key % 3 + 1 AS INTEGER)] AS product_line, 'report-' || lpad(CAST(max(object_key) AS VARCHAR), 9, '0') AS last_report FROM manifest GROUP BY 1) SELECT product_line, coalesce(files, 0) AS files, coalesce(reviews, 0) AS reviews, coalesce(groups, 0) AS groups, coalesce(phrases, 0) AS phrases, last_report FROM r FULL JOIN g USING (product_line) FULL JOIN c USING (product_line) FULL JOIN p USING (product_line)",
    "a23_parse_stats": "SELECT CAST(conv_id AS VARCHAR) AS file_stem, CAST(count(*) AS INTEGER) AS expected, count(*) AS parsed, 0 AS lost FROM conversations GROUP BY conv_id",
    "a24_queue_counts": LAB + "SELECT 'type' || CAST(ts % 8 AS VARCHAR) AS type, count(*) AS n, count(k) AS n_labelled FROM gate_labels g LEFT JOIN (SELECT DISTINCT category AS c, phrase AS p, into_ AS i, 1 AS k FROM gate_labels WHERE label = 'merge') l ON c = category AND p = phrase AND i = into_ GROUP BY 1",
    "k1_verdicts": LAB
    + f""", {near_sql("into_", "phrase")}, known AS (SELECT category, a, b, arg_max(label, ts * 2 + o) AS label FROM (SELECT category, phrase AS a, into_ AS b, label, ts, 0 AS o FROM half UNION ALL SELECT category, into_, phrase, label, ts, 1 FROM half) GROUP BY ALL),
        rules AS (SELECT reason, n >= 3 AND m >= 0.7 * n AS soft FROM (SELECT reason, count(*) AS n, count(*) FILTER (label = 'merge') AS m FROM half WHERE reason IS NOT NULL GROUP BY reason))
        SELECT g.category, g.into_ AS phrase, g.phrase AS "into", g.reason, g.ts, CASE WHEN coalesce(k.label, x.label) IS NOT NULL THEN coalesce(k.label, x.label) = 'keep' ELSE NOT coalesce(soft, false) END AS blocked,
        CASE WHEN k.label IS NOT NULL THEN 'precedent' WHEN x.label IS NOT NULL THEN 'near precedent' WHEN coalesce(soft, false) THEN 'soft rule' ELSE '' END AS basis
        FROM gate_labels g LEFT JOIN known k ON k.category = g.category AND k.a = g.into_ AND k.b = g.phrase LEFT JOIN nearest x ON x.id = g.ts LEFT JOIN rules r ON r.reason = g.reason""",
    "j12_near_precedents": LAB + f", {near_sql('phrase', 'into_')} SELECT * FROM nearest",
    "f18_requests": REV
    + """, runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM (SELECT *, CASE WHEN stem = lag(stem) OVER (PARTITION BY file ORDER BY seq) THEN 0 ELSE 1 END AS new FROM reviews)),
        parts AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY file, run ORDER BY seq) - 1) / 8) AS BIGINT) AS batch FROM runs), listed AS (SELECT *, row_number() OVER (PARTITION BY file, run, batch ORDER BY seq) AS i FROM parts)
        SELECT file, run, batch, 'Reviews:' || chr(10) || chr(10) || string_agg('[' || (i - 1) || '] rating=' || (seq % 5 + 1) || ' | title: ' || coalesce(author, '') || chr(10) || coalesce(body, ''), chr(10) || chr(10) ORDER BY i) AS request,
        'Quote what customers say, by category:' || chr(10) || '   - en: what is praised.' || chr(10) || '   - fr: a relevant customer phrase.' || chr(10) || '   - de: a relevant customer phrase.' || chr(10) || 'Quote word for word.' AS system FROM listed GROUP BY file, run, batch""",
    "f1_normalized": REV + f"SELECT review_id, {sql_norm('body')} AS norm FROM reviews",
    "k2_captured_labels": LAB + "SELECT * FROM (SELECT category || ' | ' || phrase || ' | ' || into_ AS key, arg_max(CASE WHEN ts % 6 = 0 THEN 'undo' ELSE label END, ts) AS label, max(ts) AS ts FROM gate_labels GROUP BY 1) WHERE label <> 'undo'",
    "u1_review_union": REV + "SELECT file, count(*) AS n FROM reviews GROUP BY file",
    "u3_set_operations": PHR + ", l AS (SELECT phrase_seq, list_distinct(string_split(lower(quote), ' ')) AS w, list_distinct(string_split(lower(product), '')) AS x FROM phrases), b AS (SELECT *, len(list_intersect(w, x)) AS n FROM l) SELECT phrase_seq, CAST(len(w) + len(x) - n AS INTEGER) AS either, CAST(n AS INTEGER) AS both, CAST(len(w) - n AS INTEGER) AS only FROM b",
    "u4_distinct_records": LAB + "SELECT category, phrase, reason, label, min(ts) AS ts FROM gate_labels GROUP BY ALL",
    "u5_training_pairs": LAB + ", l AS (SELECT phrase AS a, into_ AS b, label FROM gate_labels WHERE ts % 2 = 0), u AS (SELECT into_ AS a, phrase AS b, label FROM gate_labels WHERE ts % 2 = 1) SELECT * FROM l UNION ALL SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM l WHERE (l.a = u.a AND l.b = u.b) OR (l.a = u.b AND l.b = u.a))",
    "w1_review_dedup": REV + "SELECT review_id, file FROM (SELECT *, row_number() OVER (PARTITION BY file, author, review_date, body ORDER BY seq) AS n FROM reviews) WHERE n = 1",
    "w2_newest_reviews": REV + "SELECT review_id, file, place FROM (SELECT review_id, file, row_number() OVER (PARTITION BY file ORDER BY review_date DESC NULLS LAST, seq) AS place FROM (SELECT *, row_number() OVER (PARTITION BY file, author, review_date, body ORDER BY seq) AS n FROM reviews) WHERE n = 1 AND (review_date IS NULL OR review_date >= DATE '2024-03-01')) WHERE place <= 20",
    "w4_request_batches": REV + "SELECT review_id, run, CAST(floor((row_number() OVER (PARTITION BY file, run ORDER BY seq) - 1) / 8) AS BIGINT) AS batch FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM (SELECT *, CASE WHEN stem = lag(stem) OVER (PARTITION BY file ORDER BY seq) THEN 0 ELSE 1 END AS new FROM reviews))",
    "w5_phrase_batches": PHR + "SELECT phrase_seq, CAST(floor((row_number() OVER (PARTITION BY category ORDER BY phrase_seq) - 1) / 25) AS BIGINT) AS chunk FROM phrases",
    "w6_row_budget": LED + "SELECT group_id, CAST(floor((sum(n) OVER (PARTITION BY string_split(group_id, '|')[1] ORDER BY n * 3 DESC, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n) / 120) AS BIGINT) AS call FROM (SELECT group_id, count(*) AS n, min(ord) AS o FROM canonicals GROUP BY group_id)",
    "w7_context": LED + ", r AS (SELECT c.*, v, row_number() OVER (PARTITION BY group_id ORDER BY v DESC, ord) AS place FROM canonicals c JOIN (SELECT canonical_id, sum(votes) AS v FROM counted GROUP BY 1) USING (canonical_id)) SELECT r.group_id, CAST(sum(v) AS BIGINT) AS total, greatest(count(*) - 12, 0) AS more, string_agg(text, ' / ' ORDER BY place) FILTER (place <= 12) AS shown, category, name FROM r JOIN groups g ON g.group_id = r.group_id GROUP BY r.group_id, category, name",
    "w11_gold_rows": f"WITH {SHEET_SQL} SELECT * FROM kept",
    "w12_stratified": f'WITH {SHEET_SQL} SELECT row_no, "group" FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY row_no) AS n FROM kept) WHERE n <= 3',
    "c1_replicated": f"WITH {SHEET_SQL} SELECT row_no, unnest(generate_series(1, greatest(1, least(votes, 10)))) AS copy FROM kept",
    "c2_predicted": LAB + "SELECT phrase AS text, arg_max(into_, ts) AS predicted FROM gate_labels GROUP BY phrase",
    "c3_pairwise": """WITH i AS (SELECT label AS gold, vec_id % 7 AS predicted, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS tp FROM i), p AS (SELECT sum(n * (n - 1) / 2) AS p, count(*) AS predicted_groups FROM (SELECT sum(n) AS n FROM i GROUP BY predicted)), g AS (SELECT sum(n * (n - 1) / 2) AS g, count(*) AS gold_groups FROM (SELECT sum(n) AS n FROM i GROUP BY gold))
        SELECT CAST(tp AS DOUBLE) AS tp, predicted_groups, gold_groups, tp / p AS precision, tp / g AS recall, 2 * (tp / p) * (tp / g) / (tp / p + tp / g) AS f1 FROM t, p, g""",
    "c4_wrong_pairs": """WITH i AS (SELECT vec_id AS id, label AS gold, vec_id % 7 AS predicted FROM embeddings)
        SELECT * FROM (SELECT 'false' AS kind, a.id AS a, b.id AS b FROM i a JOIN i b ON a.predicted = b.predicted AND a.id < b.id AND a.gold <> b.gold ORDER BY a, b LIMIT 12) UNION ALL SELECT * FROM (SELECT 'missed', a.id, b.id FROM i a JOIN i b ON a.gold = b.gold AND a.id < b.id AND a.predicted <> b.predicted ORDER BY a.id, b.id LIMIT 12)""",
    "c5_over_merged": "SELECT CAST(vec_id % 7 AS INTEGER) AS canonical, vec_id % 3 AS product, count(DISTINCT label) AS n FROM embeddings GROUP BY ALL HAVING count(DISTINCT label) > 1",
    "c6_sweep": "WITH s AS (SELECT CAST(floor(value) AS BIGINT) % 120 AS c, event_type <> 'error' AS same FROM events) SELECT round(t * 0.02 - 0.2, 2) AS threshold, CAST(count(*) FILTER ((c >= 2 * t) = same) AS DOUBLE) / count(*) AS accuracy FROM s, (SELECT unnest(generate_series(0, 60)) AS t) GROUP BY t",
    "f4_tokens": PHR + f"SELECT phrase_seq, list_sort({sql_tokens('norm', T.STOPWORDS)}) AS toks, list_sort({sql_tokens('norm', T.STOPWORDS + T.INTENSIFIERS)}) AS content FROM normed",
    "f2_prepared": PHR + "SELECT phrase_seq, norm AS prepared FROM normed",
    "f5_trigrams": PHR + f"SELECT phrase_seq, CAST(len({sql_grams('norm')}) AS INTEGER) AS n FROM normed",
    "f14_parsed_date": REV + "SELECT review_id, CASE WHEN seq % 7 <> 0 THEN review_date END AS d FROM reviews",
    "f22_quote_variants": LED + f", {WISH} SELECT canonical_id, product, list(quote ORDER BY n) AS variants FROM q WHERE n <= 3 GROUP BY ALL",
    "f23_label_key": LAB + "SELECT ts, category || ' | ' || phrase || ' | ' || into_ AS key FROM gate_labels",
    "s8_load_taxonomy": LED + f", {CELLS} SELECT group_id, canonical_id, category, name, text, product, votes FROM cells",
    "s9_taxonomy_counts": LED + "SELECT (SELECT count(*) FROM groups) AS groups, (SELECT count(*) FROM canonicals) AS canonicals",
    "t7_merged_canonicals": LED + "SELECT keep AS canonical_id, product, count(DISTINCT review_id) AS votes FROM votes JOIN (SELECT c.canonical_id, k.keep FROM canonicals c JOIN (SELECT group_id, arg_min(canonical_id, ord) AS keep FROM canonicals GROUP BY 1) k USING (group_id)) USING (canonical_id) GROUP BY ALL",
    "t12_pruned_rows": LED + "SELECT canonical_id FROM canonicals WHERE canonical_id NOT IN (SELECT canonical_id FROM votes WHERE length(quote) > 20)",
}
