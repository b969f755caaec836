"""The registered queries of the training-data operators: thin readers of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.llm import bpe, fill_in_middle, langid, line_dedup, near_vectors, ngram_join, packing, quality, secret_scan, token_counts, topk, toxicity, vector_codes
from voxledger.llm.common import crc_mod, cut, read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), digests=True)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"), digests=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(quality.with_statistics(read_table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("held_out", crc_mod("doc_id", 4) == 2)
    labels = read_table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("quality").alias("y"))
    model = quality.fit(rows.where("not held_out").join(labels, "doc_id"), "y")
    scored = quality.predict(rows, model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_components(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = crc_mod("doc_id", 5) != 0
    model = toxicity.learn(docs.where(learned), read_table(spark, sf_dir, "labels").where(learned))
    scored = toxicity.predict(docs, model)
    return scored.select("doc_id", (~learned).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = docs.select("doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    prototypes = langid.train(held.where("not held_out"))
    return langid.predict(held.drop("lang"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform(read_table(spark, sf_dir, "documents"), digests=True)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


def sql_codes(n_parts: int = 8, n_entries: int = 16, rounds: int = 6) -> str:
    """Codebooks and codes round by round; a distance and its entry's index are compared as one number."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE {SOUND}),
        p AS MATERIALIZED (SELECT r, m, e[m * (len(e) // {n_parts}) + 1 : (m + 1) * (len(e) // {n_parts})] AS x FROM v, (SELECT unnest(range({n_parts})) AS m)),
        b0 AS MATERIALIZED (SELECT m, r - 1 AS e, x AS c FROM p WHERE r <= {n_entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, m, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {n_entries} + e) AS d FROM p JOIN b{i} USING (m) GROUP BY r, m)")
        if i < rounds:
            steps.append(
                f"""s{i} AS (SELECT m, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM (SELECT m, d % {n_entries} AS e, k, sum(x[k]) AS s, count(*) AS n FROM p JOIN a{i} USING (r, m), (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS k) GROUP BY ALL) GROUP BY m, e),
        b{i + 1} AS MATERIALIZED (SELECT b.m, b.e, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN s{i} s ON s.m = b.m AND s.e = b.e)"""
            )
    last = f"(SELECT r, string_agg(printf('%02x', CAST(d % {n_entries} AS INTEGER)), '' ORDER BY m) AS code, CAST(sum(d // {n_entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r)"
    books = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY m, e)) FROM b{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {books} AS codebooks_sha256 FROM {last} JOIN v USING (r)"


QUERIES = {f.__name__: f for f in (op1_near_vectors, op2_secrets, op3_bpe, op4_packing, op5_quality, op6_ngram_join, op7_line_dedup, op8_toxicity, op9_topk, op10_langid, op11_fill_in_middle, op12_token_counts, op13_vector_codes)}

SOUND = "embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0"
#: The fitted and tokenising operators, MinHash joins and packing have none; tests hold them against brute force, the
#: tokenizers, or held-out labels.
ORACLES: dict[str, str] = {
    "op1_near_vectors": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)""",
    "op9_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE {SOUND}),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op11_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT doc_id, t, [CAST('0x' || h[i : i + 7] AS UBIGINT) FOR i IN [1, 9, 17, 25]] AS h, list_filter(string_split(t, chr(10)), lambda x, i: i < len(string_split(t, chr(10))) OR x <> '') AS lines FROM d),
        k AS (SELECT *, len(lines) AS n, h[1] % (len(lines) + 1) AS a, h[2] % (len(lines) + 1) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        c AS (SELECT *, least(CAST(coalesce(list_sum(list_transform(lines[1 : least(a, b)], lambda x: length(x) + 1)), 0) AS BIGINT), length(t)) AS p, least(CAST(coalesce(list_sum(list_transform(lines[1 : greatest(a, b)], lambda x: length(x) + 1)), 0) AS BIGINT), length(t)) AS q FROM k),
        s AS (SELECT *, left(t, p) AS pre, substr(t, p + 1, q - p) AS mid, substr(t, q + 1) AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM s""",
    "op13_vector_codes": sql_codes(),
}
