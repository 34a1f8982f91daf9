"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphan_counts(parents: DataFrame, key: str, children: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(src_table, period, image_id, n): references of the child tables to keys the parent table lacks.

    children: (name, table, key column, time column). Parent and child keys are tagged and stacked in long form. Every
    (key, tag, period) is first summed where it is read, so a key holding a third of all rows shuffles as a few rows; then
    each key's few summed rows meet, and keys without a parent flag keep their counts. period is yyyy-MM, 'none' for a null
    time. Null and non-positive keys refer to nothing and are left out; replayed rows count each time. Empty tables are
    allowed on either side.
    """

    def month(t: Column) -> Column:
        return F.coalesce(F.date_format(t, "yyyy-MM"), F.lit("none"))

    long = parents.select(F.col(key).cast("bigint").alias("image_id"), F.lit(None).cast("string").alias("src_table"), F.lit(None).cast("string").alias("period"))
    for name, table, ref, time in children:
        long = long.unionByName(table.select(F.col(ref).cast("bigint").alias("image_id"), F.lit(name).alias("src_table"), month(F.col(time)).alias("period")))
    summed = long.where("image_id > 0").groupBy("image_id", "src_table", "period").agg(F.count("*").alias("n"))
    by_key = summed.groupBy("image_id").agg(
        F.max(F.col("src_table").isNull()).alias("has_parent"),
        F.collect_list(F.when(F.col("src_table").isNotNull(), F.struct("src_table", "period", "n"))).alias("refs"),
    )
    return by_key.where(~F.col("has_parent")).select("image_id", F.explode("refs").alias("r")).select("r.src_table", "r.period", "image_id", "r.n")


def orphan_report(parents: DataFrame, key: str, children: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(src_table, period, missing_ids, refs): the orphan references of each table and month."""
    found = orphan_counts(parents, key, children)
    return found.groupBy("src_table", "period").agg(F.count("*").alias("missing_ids"), F.sum("n").alias("refs"))
