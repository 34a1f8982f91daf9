"""The report of a mosaic: worst matches with their causes, uses, a heat map, and a page that shows them."""

from __future__ import annotations

import html
import os
import shutil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import analysis
from gridloom.sinks.raster import png_bytes

#: Bad matches shown, and most of the repeated images copied.
WORST, COPIED = 20, 200


def write_report(found: DataFrame, winners: DataFrame, folder: str, nx: int, ny: int) -> dict:
    """Writes the report of one mosaic into a folder.

    found: a tile's scored candidates (mosaic.scored_candidates); winners: (tile, image_id, score). Only the worst matches, the
    most used images and a colour a tile come to the driver. Files: worst.txt, heatmap.png, uses/rankNN_..., report.html.
    Returns the counts shown.
    """
    os.makedirs(f"{folder}/uses", exist_ok=True)
    one = found.select("tile", F.col("id").alias("image_id"), "d_lab", "d_grid", "d_tiny", "d_edge", "d_texture", "t_avg_l", "file_path", "category", "ann_rank")
    matched = winners.select("tile", "image_id", "score").join(one, ["tile", "image_id"])
    uses = winners.groupBy("image_id").agg(F.count("*").alias("uses"))
    matched = matched.join(uses, "image_id")
    cause = analysis.worst_cause(F.col("d_lab"), F.col("d_grid"), F.col("t_avg_l"), F.col("uses"))
    worst = matched.withColumn("cause", cause).orderBy(F.desc("score"), F.desc("tile")).limit(WORST).collect()
    heats = analysis.heat_ramp(analysis.heatmap(winners.select(F.lit(0).alias("run_id"), F.col("tile").alias("tile_idx"), "score"))).collect()
    picture = np.zeros((ny, nx, 3), np.uint8)
    for r in heats:
        picture[r.tile_idx // nx, r.tile_idx % nx] = (r.r, r.g, r.b)
    with open(f"{folder}/heatmap.png", "wb") as out:
        out.write(png_bytes(picture.repeat(8, 0).repeat(8, 1)))
    copied = 0
    for r in matched.where("uses >= 2").select("image_id", "uses", "file_path").distinct().orderBy(F.desc("uses"), "image_id").limit(COPIED).collect():
        if r.file_path and os.path.isfile(r.file_path):
            copied += 1
            shutil.copyfile(r.file_path, f"{folder}/uses/rank{copied:02d}_{r.uses}x_id{r.image_id}_{os.path.basename(r.file_path)}")
    parts = matched.agg(*[F.avg(c).alias(c) for c in ("score", "d_lab", "d_grid", "d_tiny", "d_edge", "d_texture")]).first().asDict()
    lines = [f"#{i} tile({r.tile % nx},{r.tile // nx}) score={r.score:.4f} image={r.image_id} colour={r.d_lab:.4f} layout={r.d_grid:.4f} edges={r.d_edge:.4f} uses={r.uses} cause={r.cause}" for i, r in enumerate(worst, 1)]
    with open(f"{folder}/worst.txt", "w") as out:
        out.write("\n".join(lines) + "\n")
    rows = "".join(f"<tr><td>{html.escape(line)}</td></tr>" for line in lines)
    means = ", ".join(f"{k} {v:.4f}" for k, v in parts.items() if v is not None)
    with open(f"{folder}/report.html", "w") as out:
        out.write(f"<!DOCTYPE html><meta charset='utf-8'><title>Report</title><h1>Matches</h1><p>{len(heats)} tiles; means: {means}</p><img src='heatmap.png' alt='scores'><table>{rows}</table>\n")
    return {"worst": len(worst), "tiles": len(heats), "copied": copied}
