"""Queries of the general training-data operators in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators.references import orphan_counts, orphan_report
from gridloom.session import table


def _children(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, str, str]]:
    return [("usage_stats", table(spark, folder, "usage_stats"), "image_id", "last_used"), ("winners", table(spark, folder, "winners"), "image_id", "run_at")]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(table(spark, folder, "images"), "id", _children(spark, folder)).select("src_table", "period", "image_id")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(table(spark, folder, "images"), "id", _children(spark, folder))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}

_REFS = """
refs AS (
  SELECT 'usage_stats' AS src_table, image_id, last_used AS t FROM usage_stats
  UNION ALL SELECT 'winners', image_id, run_at FROM winners),
missing AS (
  SELECT src_table, coalesce(strftime(t, '%Y-%m'), 'none') AS period, image_id FROM refs
  WHERE image_id > 0 AND image_id NOT IN (SELECT id FROM images WHERE id IS NOT NULL))
"""
SQL = {
    "p6_found": f"WITH {_REFS} SELECT DISTINCT src_table, period, image_id FROM missing",
    "p6_report": f"WITH {_REFS} SELECT src_table, period, count(DISTINCT image_id) AS missing_ids, count(*) AS refs FROM missing GROUP BY ALL",
}
