"""Scan-history queries, bound to ``orders``: user = o_custkey, entry = o_orderkey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.classify import score_tier
from millrace.operators.history import merge_history
from millrace.session import table

USER = 85


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("date_scanned"),
        (1 + F.col("o_orderkey") % 100).cast("int").alias("overall_score"),
    )


def e3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote top 50, plus local rows not there, newest 50 of both, labelled."""
    mine = _entries(spark, sf_dir).where(F.col("user_id") == USER)
    remote = mine.where(F.col("id") % 3 != 0)
    local = mine.where(F.col("id") % 3 != 1)
    merged = merge_history(remote, local, limit=50)
    return merged.select("id", "user_id", "date_scanned", "overall_score", score_tier(F.col("overall_score")).alias("tier"), "src")


_TIER = """CASE WHEN overall_score >= 85 THEN 'EXCELLENT' WHEN overall_score >= 70 THEN 'GOOD'
 WHEN overall_score >= 50 THEN 'AVERAGE' WHEN overall_score >= 30 THEN 'BELOW AVERAGE' ELSE 'POOR' END"""

QUERIES = {"e3_history": e3_history}
ORACLES = {
    "e3_history": f"""
WITH mine AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS date_scanned,
        CAST(1 + o_orderkey % 100 AS INTEGER) AS overall_score FROM orders WHERE o_custkey = {USER}),
 remote AS (SELECT * FROM mine WHERE id % 3 <> 0 ORDER BY date_scanned DESC, id LIMIT 50),
 local AS (SELECT * FROM mine WHERE id % 3 <> 1 AND id NOT IN (SELECT id FROM remote)),
 both_src AS (SELECT *, 0 AS src FROM local UNION ALL SELECT *, 1 AS src FROM remote)
SELECT id, user_id, date_scanned, overall_score, {_TIER} AS tier, CAST(src AS INTEGER) AS src FROM both_src
ORDER BY date_scanned DESC, src, id LIMIT 50"""
}
