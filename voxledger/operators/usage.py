"""Usage and cost of runs, prices, and which stored objects to evict.

``usage`` has run_id, ts, product_line, extract_model, group_model, calls, input_tokens, cached_tokens,
output_tokens, cost_usd, cost_known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kpis(usage: DataFrame) -> DataFrame:
    return usage.agg(
        F.count("*").alias("runs"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        F.sum(F.when(F.col("cost_known"), F.col("cost_usd"))).alias("known_cost"),
        F.count_if(~F.col("cost_known")).alias("unknown_price_runs"),
    )


def known(usage: DataFrame, product_line: str | None = None) -> DataFrame:
    """Runs whose cost is known, of one product line if one is named."""
    out = usage.where("cost_known")
    return out if product_line is None else out.where(F.col("product_line") == product_line)


def daily(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("ts").alias("day")).agg(F.sum("cost_usd").alias("cost_usd"), F.sum("input_tokens").alias("input_tokens"))


def by_model(usage: DataFrame) -> DataFrame:
    """Runs, tokens and cost by model; a run counts under its extracting and under its grouping model."""
    both = usage.select(F.col("extract_model").alias("model"), "input_tokens", "cost_usd").unionAll(usage.select("group_model", "input_tokens", "cost_usd"))
    return both.where("model is not null").groupBy("model").agg(F.count("*").alias("runs"), F.sum("input_tokens").alias("input_tokens"), F.sum("cost_usd").alias("cost_usd"))


def combined(usage: DataFrame, by: str) -> DataFrame:
    """Usage over several logs; the cost is known only where every part's is."""
    return usage.groupBy(by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.when(F.bool_and("cost_known"), F.sum("cost_usd")).alias("cost_usd"), F.bool_and("cost_known").alias("cost_known"))


def newest_first(usage: DataFrame) -> DataFrame:
    return usage.withColumn("place", F.row_number().over(Window.partitionBy("product_line").orderBy(F.desc("ts"), F.desc("run_id"))))


def model_name(model: Column) -> Column:
    """A model's name without its provider and without a date at its end."""
    return F.regexp_replace(F.regexp_replace(F.lower(model), r"^.*/", ""), r"[-@]\d{8}$", "")


def priced(calls: DataFrame, prices: DataFrame, cached_factor: float = 0.1, written_factor: float = 1.25) -> DataFrame:
    """Cost of calls by a small price table(model, input_per_m, output_per_m); null where the model has none.

    ``calls`` has model, input_tokens, cache_read_tokens, cache_write_tokens, output_tokens.
    """
    rows = calls.withColumn("model_key", model_name(F.col("model"))).join(prices.withColumnRenamed("model", "model_key"), "model_key", "left")
    cost = (F.col("input_tokens") * F.col("input_per_m") + F.col("cache_read_tokens") * cached_factor * F.col("input_per_m") + F.col("cache_write_tokens") * written_factor * F.col("input_per_m") + F.col("output_tokens") * F.col("output_per_m")) / 1e6
    return rows.withColumn("cost_usd", cost).withColumn("cost_known", F.col("cost_usd").isNotNull()).drop("input_per_m", "output_per_m")


def evicted(manifest: DataFrame, cap: int, by: str | None = None) -> DataFrame:
    """Objects to evict, oldest first, until what is left fits the cap.

    ``manifest`` has object_key, size, last_modified and, with ``by``, the store that each object is in. The
    running sum is over one store, in two levels: by day, then within a day.
    """
    store = F.lit(0) if by is None else F.col(by)
    rows = manifest.withColumn("_store", store).withColumn("_day", F.to_date("last_modified"))
    days = rows.groupBy("_store", "_day").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_store").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before_day", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).withColumn("_total", F.sum("_sum").over(Window.partitionBy("_store")))
    within = Window.partitionBy("_store", "_day").orderBy("last_modified", "object_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in_day", F.coalesce(F.sum("size").over(within), F.lit(0))).join(days.drop("_sum"), ["_store", "_day"])
    return rows.where(F.col("_total") - F.col("_before_day") - F.col("_in_day") > cap).select(*manifest.columns)
