"""Keeping a library's files and rows together: export with copies, rows without files, purges, feature packs."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.library import usage_export


def export_files(usage: DataFrame, images: DataFrame, folder: str) -> DataFrame:
    """(image_id, rank, file_name, status): used images copied under their export names into a folder all tasks share.

    status: exported, unknown (the library has no such image), missing (it has no such file) or failed. Runs again safely."""
    rows = usage_export(usage, images).join(images.select(F.col("id").alias("image_id"), "file_path"), "image_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            status = []
            for r in b.itertuples(index=False):
                if not r.found:
                    status.append("unknown")
                elif not os.path.isfile(r.file_path):
                    status.append("missing")
                else:
                    try:
                        shutil.copyfile(r.file_path, f"{folder}/{r.file_name}")
                        status.append("exported")
                    except OSError:
                        status.append("failed")
            yield b.drop(columns=["found", "file_path"]).assign(status=status)

    return rows.select("image_id", "rank", "file_name", "found", "file_path").mapInPandas(run, "image_id bigint, rank bigint, file_name string, status string")


def rows_without_file(images: DataFrame) -> DataFrame:
    """(id, file_path) of the rows whose file isn't there (null paths included), looked up where the rows are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[p is None or not os.path.exists(p) for p in b["file_path"]]]

    return images.select("id", "file_path").mapInPandas(run, "id bigint, file_path string")


def purged(images: DataFrame) -> DataFrame:
    """The rows whose file is there."""
    return images.join(rows_without_file(images).select("id"), "id", "left_anti").select(*images.columns)


def merged_pack(pack: DataFrame, fresh: DataFrame, images: DataFrame) -> DataFrame:
    """(id, values..., reused): one pack row per library image: the old pack's if it has one, else the fresh one's; images in
    neither have null values. Ids the library lacks leave the pack; of repeated rows of an id the least is kept. Rows come
    sorted by id within each part."""
    values = [c for c in pack.columns if c != "id"]

    def one(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.min(F.struct(*values)).alias("r"))

    old, new = one(pack).withColumnRenamed("r", "old"), one(fresh.select("id", *values)).withColumnRenamed("r", "new")
    both = images.select("id").distinct().join(old, "id", "left").join(new, "id", "left").withColumn("r", F.coalesce("old", "new"))
    return both.select("id", *[F.col("r")[c].alias(c) for c in values], F.col("old").isNotNull().alias("reused")).sortWithinPartitions("id")


def aligned_pack(pack: DataFrame, images: DataFrame) -> DataFrame:
    """pack if it holds exactly the library's ids, each once and none below zero; ValueError if not, so that a stale one is rebuilt."""
    ids = images.select("id").distinct().withColumn("_l", F.lit(1))
    counts = pack.groupBy("id").count().join(ids, "id", "full")
    wrong = counts.where("_l IS NULL OR count IS NULL OR count > 1 OR id IS NULL OR id < 0").take(1)
    if wrong:
        raise ValueError(f"pack doesn't fit the library: id {wrong[0].id}")
    return pack


def in_degrees(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(rows, least, most, none): how often a row is among the neighbours (id) of others; rows nobody has count as 0."""
    counts = rows.select("id").join(links.groupBy("id").count(), "id", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    return counts.agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("none"))


def time_left(done: int, all_: int, seconds: float) -> float | None:
    """Seconds still to go at the pace so far; None before anything is done."""
    return (all_ - done) * seconds / done if done > 0 else None
