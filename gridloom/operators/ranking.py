"""Exact ranks within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut


def spread_rank(df: DataFrame, groups: list[str], orders: list[Column], rank: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row in its group under a total order (end it with a unique column).

    Rows are range-partitioned by group and order, so a group holding a third of all rows spans many tasks; each task ranks
    its own slice, and slices add the counts of the slices before them. Nulls in groups form a group of their own. An empty
    table gives an empty table.
    """
    piece, before = "_piece", "_before"
    sliced = cut(df.repartitionByRange(*[F.col(g) for g in groups], *orders).withColumn(piece, F.spark_partition_id()))
    counts = sliced.groupBy(*groups, piece).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*groups).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(piece).alias("_p"), F.coalesce(F.sum("_n").over(running), F.lit(0)).alias(before))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)] + [F.col(piece) == F.col("_p")]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    local = F.row_number().over(Window.partitionBy(*groups, piece).orderBy(*orders))
    ranked = sliced.withColumn("_local", local).join(counts, condition)
    return ranked.withColumn(rank, F.col("_local") + F.col(before)).select(*df.columns, rank)
