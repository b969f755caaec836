"""Queries of the usage and retention reports and their SQL. Costs are whole cents here, so that sums don't depend
on the order of addition."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxledger.operators import usage as U
from voxledger.plans.bindings import MANIFEST_SQL, USAGE_SQL, manifest, usage

W = f"WITH {USAGE_SQL} "
PRICES = [("model-error", 3.0, 15.0), ("model-click", 1.0, 5.0), ("model-view", 0.25, 1.25)]
CAP = 100_000


def over(f):
    return lambda spark, sf_dir: f(usage(spark, sf_dir))


def prices(spark):
    return spark.createDataFrame(PRICES, "model string, input_per_m double, output_per_m double")


def evicted(spark, sf_dir):
    return U.evicted(manifest(spark, sf_dir), CAP).select("object_key", "size")


QUERIES = {
    "a18_usage_kpis": over(U.kpis),
    "a19_daily_usage": over(U.daily),
    "a20_usage_by_model": over(U.by_model),
    "a21_combined_usage": over(lambda u: U.combined(u, "product_line")),
    "p14_known_cost": over(lambda u: U.known(u, "line3").select("run_id", "product_line", "cost_usd")),
    "w14_newest_first": over(lambda u: U.newest_first(u).select("run_id", "product_line", "place")),
    "u2_model_union": over(lambda u: u.select(F.col("extract_model").alias("model")).unionAll(u.select("group_model")).groupBy("model").agg(F.count("*").alias("n"))),
    "s11_usage_history": over(lambda u: u.orderBy("ts", "run_id").select("run_id", "ts", "product_line", "input_tokens", "cost_usd")),
    "f21_priced_calls": lambda s, d: U.priced(usage(s, d).select("run_id", F.col("extract_model").alias("model"), "input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens"), prices(s)).select("run_id", "model_key", F.round("cost_usd", 8).alias("cost_usd"), "cost_known"),
    "w13_evicted_objects": evicted,
}
ORACLES = {
    "a18_usage_kpis": W + "SELECT count(*) AS runs, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(sum(cost_usd) FILTER (cost_known) AS BIGINT) AS known_cost, count(*) FILTER (NOT cost_known) AS unknown_price_runs FROM usage",
    "a19_daily_usage": W + "SELECT CAST(ts AS DATE) AS day, CAST(sum(cost_usd) AS BIGINT) AS cost_usd, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM usage GROUP BY 1",
    "a20_usage_by_model": W + "SELECT model, count(*) AS runs, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cost_usd) AS BIGINT) AS cost_usd FROM (SELECT extract_model AS model, input_tokens, cost_usd FROM usage UNION ALL SELECT group_model, input_tokens, cost_usd FROM usage) WHERE model IS NOT NULL GROUP BY model",
    "a21_combined_usage": W + "SELECT product_line, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CASE WHEN bool_and(cost_known) THEN CAST(sum(cost_usd) AS BIGINT) END AS cost_usd, bool_and(cost_known) AS cost_known FROM usage GROUP BY product_line",
    "p14_known_cost": W + "SELECT run_id, product_line, cost_usd FROM usage WHERE cost_known AND product_line = 'line3'",
    "w14_newest_first": W + "SELECT run_id, product_line, row_number() OVER (PARTITION BY product_line ORDER BY ts DESC, run_id DESC) AS place FROM usage",
    "u2_model_union": W + "SELECT model, count(*) AS n FROM (SELECT extract_model AS model FROM usage UNION ALL SELECT group_model FROM usage) GROUP BY model",
    "s11_usage_history": W + "SELECT run_id, ts, product_line, input_tokens, cost_usd FROM usage ORDER BY ts, run_id",
    "f21_priced_calls": W
    + f"""SELECT run_id, k AS model_key, round((input_tokens * i + cache_read_tokens * 0.1 * i + cache_write_tokens * 1.25 * i + output_tokens * o) / 1e6, 8) AS cost_usd, i IS NOT NULL AS cost_known
        FROM (SELECT *, regexp_replace(regexp_replace(lower(extract_model), '^.*/', ''), '[-@][0-9]{{8}}$', '') AS k FROM usage) u
        LEFT JOIN (SELECT * FROM (VALUES {", ".join(f"('{m}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for m, a, b in PRICES)}) p(m, i, o)) p ON u.k = p.m""",
    "w13_evicted_objects": f"WITH {MANIFEST_SQL} SELECT object_key, size FROM (SELECT *, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY last_modified, object_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM manifest) WHERE total - before > {CAP}",
}
