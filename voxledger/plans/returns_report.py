"""Queries of the returns report and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxledger.functions import returns_vocabulary as V
from voxledger.operators import returns as R
from voxledger.plans.bindings import RETURNS_SQL, quoted, returns, sql_list

TOPIC_SQL = "CASE WHEN customer_comments IS NULL OR c IN (" + ", ".join(map(quoted, V.TRIVIAL_COMMENTS)) + ") OR length(c) <= 2 THEN 'NO_COMMENT' " + " ".join("WHEN " + " OR ".join(f"contains(c, {quoted(w)})" for w in words) + f" THEN {quoted(topic)}" for topic, words in V.TOPIC_KEYWORDS.items()) + " ELSE 'OTHER' END"
FITS_SQL = " OR ".join(f"(reason = {quoted(r)} AND list_contains({sql_list(ts)}, comment_topic))" for r, ts in V.EXPECTED_TOPICS.items() if ts)
LABEL_SQL = "CASE comment_topic " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in V.TRUE_REASON_LABELS.items()) + " ELSE reason END"
CLASSIFIED_SQL = f"""{RETURNS_SQL},
  lowered AS (SELECT *, lower(trim(customer_comments)) AS c FROM returns),
  topics AS (SELECT *, {TOPIC_SQL} AS comment_topic FROM lowered),
  statuses AS (SELECT *, CASE WHEN comment_topic = 'NO_COMMENT' THEN 'No Comment' WHEN comment_topic = 'OTHER' THEN 'Unclear' WHEN coalesce({FITS_SQL}, false) THEN 'Match' ELSE 'Mismatch' END AS status FROM topics),
  classified AS (SELECT *, CASE WHEN status = 'Mismatch' THEN {LABEL_SQL} ELSE reason END AS true_reason FROM statuses)"""


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST(round_even(CAST({part} AS DOUBLE) * 100.0 / {whole}, 1) AS DOUBLE) ELSE 0.0 END"


def ranked(column: str, by: str = "asin", where: str = "true") -> str:
    return f"(SELECT {by}, {column}, n, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, f) AS rank FROM (SELECT {by}, {column}, count(*) AS n, min(row_seq) AS f FROM classified WHERE {column} IS NOT NULL AND {where} GROUP BY {by}, {column}))"


SUMMARY_SQL = f"""SELECT *, {pct("n_mismatch", "with_comment")} AS mismatch_pct, row_number() OVER (ORDER BY f) AS place FROM (
  SELECT asin, arg_min(product_name, row_seq) AS product_name, count(*) AS total, count(*) FILTER (status <> 'No Comment') AS with_comment, count(*) FILTER (status = 'Match') AS n_match,
    count(*) FILTER (status = 'Mismatch') AS n_mismatch, count(*) FILTER (status = 'Unclear') AS n_unclear, count(*) FILTER (status = 'No Comment') AS n_no_comment, min(row_seq) AS f FROM classified GROUP BY asin)"""
TOPICS_SQL = f"SELECT *, {pct('n', 'sum(n) OVER (PARTITION BY asin)')} AS pct FROM {ranked('comment_topic', where=chr(39).join(['comment_topic <> ', 'NO_COMMENT', '']))}"
TRUES_SQL = f"SELECT r.*, {pct('n', 'total')} AS pct FROM {ranked('true_reason')} r JOIN (SELECT asin, count(*) AS total FROM classified GROUP BY asin) USING (asin)"
MISMATCH_SQL = f"""SELECT c.asin, c.reason, c.n, t.true_reason AS top_true, {pct("c.n", "total")} AS pct, row_number() OVER (PARTITION BY c.asin ORDER BY c.n DESC, c.reason) AS rank
  FROM (SELECT asin, reason, count(*) AS n FROM classified WHERE status = 'Mismatch' AND reason IS NOT NULL GROUP BY asin, reason) c
  LEFT JOIN (SELECT * FROM {ranked("true_reason", "asin, reason", "status = 'Mismatch'")} WHERE rank = 1) t ON c.asin = t.asin AND c.reason = t.reason
  JOIN (SELECT asin, count(*) AS total FROM classified WHERE status = 'Mismatch' GROUP BY asin) m ON c.asin = m.asin"""

ROW_COLUMNS = ["return_date", "asin", "product_name", "quantity", "reason", "customer_comments"]


def over(f):
    """A query that applies ``f`` to the classified ledger."""
    return lambda spark, sf_dir: f(R.classified(returns(spark, sf_dir)))


def named(columns: list[str]):
    return lambda df: df.select(*columns)


QUERIES = {
    "s1_returns_ledger": lambda s, d: returns(s, d).select(*ROW_COLUMNS),
    "p1_return_date": lambda s, d: returns(s, d).select("asin", R.returned_on(F.when(F.length("product_name") % 3 == 0, "not a date").otherwise(F.date_format("return_date", "yyyy-MM-dd HH:mm:ss"))).alias("return_date")),
    "p2_product_list": lambda s, d: R.product_list(returns(s, d)),
    "p2_only_products": lambda s, d: R.only_products(returns(s, d), R.product_list(returns(s, d)).where("asin like '%1%'")).select(*ROW_COLUMNS),
    "p3_comment_topic": over(named(["asin", "customer_comments", "comment_topic"])),
    "p4_status": over(named(["asin", "reason", "comment_topic", "status"])),
    "p5_true_reason": over(named(["asin", "reason", "status", "true_reason"])),
    "p6_severity": over(lambda c: R.severity(R.product_summary(c))),
    "a1_product_summary": over(R.product_summary),
    "a2_top_true_reasons": over(R.top_true_reasons),
    "a3_topic_distribution": over(R.topic_distribution),
    "a4_true_reason_distribution": over(R.true_reason_distribution),
    "a5_mismatch_analysis": over(R.mismatch_analysis),
    "a6_panels": over(R.panels),
    "a7_headline": over(R.headline),
    "w8_detail_order": over(lambda c: R.detail_order(c).select("asin", "n_returns", "asin_rank", "row_rank", "return_date", "reason", "true_reason")),
}
W = f"WITH {RETURNS_SQL} "
C = f"WITH {CLASSIFIED_SQL} "
ORACLES = {
    "s1_returns_ledger": W + "SELECT " + ", ".join(ROW_COLUMNS) + " FROM returns",
    "p1_return_date": W + "SELECT asin, CASE WHEN length(product_name) % 3 <> 0 THEN return_date END AS return_date FROM returns",
    "p2_product_list": W + "SELECT DISTINCT asin FROM returns WHERE asin IS NOT NULL",
    "p2_only_products": W + "SELECT " + ", ".join(ROW_COLUMNS) + " FROM returns WHERE asin LIKE '%1%'",
    "p3_comment_topic": C + "SELECT asin, customer_comments, comment_topic FROM classified",
    "p4_status": C + "SELECT asin, reason, comment_topic, status FROM classified",
    "p5_true_reason": C + "SELECT asin, reason, status, true_reason FROM classified",
    "p6_severity": C + f"""SELECT asin, CASE WHEN mismatch_pct >= 20 THEN 'high' WHEN mismatch_pct >= 10 THEN 'medium' ELSE 'low' END AS band,
        CASE WHEN length(product_name) > 80 THEN substr(product_name, 1, 80) || '...' ELSE product_name END AS short_name,
        repeat('█', b) || repeat('░', 8 - b) AS bar FROM (SELECT *, CAST(greatest(0, least(8, round_even(mismatch_pct / 100 * 8, 0))) AS INTEGER) AS b FROM ({SUMMARY_SQL}))""",
    "a1_product_summary": C + f"SELECT asin, product_name, total, with_comment, n_match, n_mismatch, n_unclear, n_no_comment, mismatch_pct, place FROM ({SUMMARY_SQL})",
    "a2_top_true_reasons": C
    + f"""SELECT a.asin, coalesce(max(CASE WHEN rank = 1 THEN true_reason END), '') AS top_1, coalesce(max(CASE WHEN rank = 2 THEN true_reason END), '') AS top_2, coalesce(max(CASE WHEN rank = 3 THEN true_reason END), '') AS top_3
        FROM (SELECT DISTINCT asin FROM classified) a LEFT JOIN {ranked("true_reason", where="status = 'Mismatch'")} r ON a.asin = r.asin GROUP BY a.asin""",
    "a3_topic_distribution": C + TOPICS_SQL,
    "a4_true_reason_distribution": C + TRUES_SQL,
    "a5_mismatch_analysis": C + MISMATCH_SQL,
    "a6_panels": C
    + f"""SELECT coalesce(t.asin, r.asin, m.asin) AS asin, coalesce(t.rank, r.rank, m.rank) AS rank, t.comment_topic AS topic, t.n AS topic_n, r.true_reason, r.n AS true_n, m.reason AS stated, m.n AS stated_n, m.top_true
        FROM (SELECT * FROM ({TOPICS_SQL}) WHERE rank <= 12) t FULL JOIN (SELECT * FROM ({TRUES_SQL}) WHERE rank <= 12) r ON t.asin = r.asin AND t.rank = r.rank
        FULL JOIN (SELECT * FROM ({MISMATCH_SQL}) WHERE rank <= 12) m ON coalesce(t.asin, r.asin) = m.asin AND coalesce(t.rank, r.rank) = m.rank""",
    "a7_headline": C + f"SELECT n_rows, n_mismatch, {pct('n_mismatch', '(n_mismatch + n_match)')} AS mismatch_pct FROM (SELECT count(*) AS n_rows, count(*) FILTER (status = 'Mismatch') AS n_mismatch, count(*) FILTER (status = 'Match') AS n_match FROM classified)",
    "w8_detail_order": C
    + """SELECT asin, n_returns, asin_rank, row_number() OVER (PARTITION BY asin ORDER BY return_date DESC NULLS LAST, row_seq) AS row_rank, return_date, reason, true_reason
        FROM classified JOIN (SELECT asin, n_returns, row_number() OVER (ORDER BY n_returns DESC, f) AS asin_rank FROM (SELECT asin, count(*) AS n_returns, min(row_seq) AS f FROM classified GROUP BY asin)) USING (asin)""",
}
