"""Features of pixel tables (image_id, y, x, b, g, r), rasters without remainder rows, and image pyramids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# sRGB to XYZ to LAB, reference white, and the 8-bit scale of L, a and b; grey weights.
RGB_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (95.047, 100.0, 108.883)
GREY = (0.299, 0.587, 0.114)
EDGE_STEP = 30


def grey(r: Column, g: Column, b: Column) -> Column:
    return GREY[0] * r + GREY[1] * g + GREY[2] * b


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L (0..255), a and b (128 = neutral) of 8-bit RGB."""
    linear = [F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, 2.4)).otherwise(c / 255.0 / 12.92) * 100 for c in (r, g, b)]
    xyz = [sum((linear[k] * row[k] for k in range(3)), F.lit(0.0)) / w for row, w in zip(RGB_XYZ, WHITE)]
    x, y, z = (F.when(v > 0.008856, F.pow(v, 1 / 3)).otherwise(7.787 * v + 16 / 116) for v in xyz)
    return (116 * y - 16) * 2.55, 500 * (x - y) + 128, 200 * (y - z) + 128


def with_colour(pixels: DataFrame) -> DataFrame:
    l, a, b = lab(F.col("r"), F.col("g"), F.col("b"))
    return pixels.select("image_id", "y", "x", "r", "g", "b", l.alias("lab_l"), a.alias("lab_a"), b.alias("lab_b"), grey(F.col("r"), F.col("g"), F.col("b")).alias("grey"))


def image_features(pixels: DataFrame) -> DataFrame:
    """One row per image: size, mean LAB, brightness mean and deviation, contrast, saturation and colour variance."""
    p = with_colour(pixels)
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return p.groupBy("image_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.avg("lab_l").alias("avg_l"), F.avg("lab_a").alias("avg_a"), F.avg("lab_b").alias("avg_b"),
        F.avg("grey").alias("mean_brightness"), F.stddev_pop("grey").alias("std_brightness"), (F.stddev_pop("grey") / 255).alias("contrast"),
        F.avg(F.when(top > 0, (top - low) / top * 255).otherwise(0.0)).alias("saturation"), (F.var_pop("lab_a") + F.var_pop("lab_b")).alias("color_variance"),
    )


def grid_cells(pixels: DataFrame, side: int = 8) -> DataFrame:
    """(image_id, cell, l, a, b): cell means of a side x side grid; rows and columns beyond whole cells are left out, and images
    smaller than the grid have no cells."""
    p = with_colour(pixels)
    size = p.groupBy("image_id").agg(F.floor((F.max("y") + 1) / side).alias("ch"), F.floor((F.max("x") + 1) / side).alias("cw")).where("ch > 0 AND cw > 0")
    cell = F.floor(F.col("y") / F.col("ch")) * side + F.floor(F.col("x") / F.col("cw"))
    inside = p.join(size, "image_id").where((F.col("y") < F.col("ch") * side) & (F.col("x") < F.col("cw") * side))
    return inside.groupBy("image_id", cell.cast("int").alias("cell")).agg(F.avg("lab_l").alias("l"), F.avg("lab_a").alias("a"), F.avg("lab_b").alias("b"))


def grids(cells: DataFrame) -> DataFrame:
    """(image_id, grid): the cells' values in order; a grid's cells are bounded by its size."""
    return cells.groupBy("image_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("cell", F.array("l", "a", "b").alias("v")))), lambda s: s["v"])).alias("grid"))


def tiny_images(pixels: DataFrame, side: int = 16) -> DataFrame:
    """(image_id, cell, grey): a side x side grey thumbnail by area means (exact for sizes that divide)."""
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    cell = F.floor(F.col("y") * side / F.col("h")) * side + F.floor(F.col("x") * side / F.col("w"))
    return pixels.join(size, "image_id").groupBy("image_id", cell.cast("int").alias("cell")).agg(F.avg(grey(F.col("r"), F.col("g"), F.col("b"))).alias("grey"))


def pattern_counts(pixels: DataFrame) -> DataFrame:
    """(image_id, code, n, share): local binary patterns of all inner pixels, by three windows along columns and rows."""
    p = pixels.select("image_id", "y", "x", grey(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    p = p.withColumn("l", F.lag("v").over(row)).withColumn("r", F.lead("v").over(row))
    for name in ("l", "v", "r"):
        p = p.withColumn(f"u{name}", F.lag(name).over(col)).withColumn(f"d{name}", F.lead(name).over(col))
    around = ["ul", "uv", "ur", "r", "dr", "dv", "dl", "l"]
    code = sum((F.when(F.col(c) >= F.col("v"), 1 << i).otherwise(0) for i, c in enumerate(around)), F.lit(0))
    inner = p.where(" AND ".join(f"{c} IS NOT NULL" for c in around)).groupBy("image_id", code.alias("code")).agg(F.count("*").alias("n"))
    whole = inner.groupBy("image_id").agg(F.sum("n").alias("whole"))
    return inner.join(whole, "image_id").select("image_id", "code", "n", (F.col("n") / F.col("whole")).alias("share"))


def edge_density(pixels: DataFrame) -> DataFrame:
    """(image_id, edge_density): share of pixels whose steps from the left and upper pixel sum to more than EDGE_STEP."""
    v = grey(F.col("r"), F.col("g"), F.col("b"))
    p = pixels.select("image_id", "y", "x", v.alias("v"))
    step = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("image_id", "y").orderBy("x"))) + F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("image_id", "x").orderBy("y")))
    return p.withColumn("s", step).groupBy("image_id").agg(F.avg((F.coalesce("s", F.lit(0)) > EDGE_STEP).cast("double")).alias("edge_density"))


def levels(width: int, height: int) -> int:
    """Number of the largest level of a pyramid that ends in one pixel."""
    n, side = 0, max(width, height)
    while side > 1:
        side = -(-side // 2)
        n += 1
    return n


def pyramid(pixels: DataFrame, width: int, height: int, tile: int = 256) -> DataFrame:
    """(image_id, level, y, x, b, g, r, tile_y, tile_x): every level is the mean of 2 x 2 pixels of the next larger one.

    Level sizes are known from the width and height, so all levels are one plan of chained partial aggregations.
    """
    level = levels(width, height)
    now = pixels.select("image_id", "y", "x", *[F.col(c).cast("double").alias(c) for c in "bgr"])
    made = now.withColumn("level", F.lit(level))
    while level > 0:
        level -= 1
        now = now.groupBy("image_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(*[F.avg(c).alias(c) for c in "bgr"])
        made = made.unionByName(now.withColumn("level", F.lit(level)))
    return made.withColumn("tile_y", F.floor(F.col("y") / tile)).withColumn("tile_x", F.floor(F.col("x") / tile))


def tile_grid(spark, width: int, height: int, tile_w: int, tile_h: int) -> DataFrame:
    """(tile_idx, ty, tx, x0, y0, pad_x, pad_y): the target cut into whole tiles; the last column and row are padded."""
    nx, ny = -(-width // tile_w), -(-height // tile_h)
    t = spark.range(nx * ny).select(F.col("id").alias("tile_idx"), F.floor(F.col("id") / nx).alias("ty"), (F.col("id") % nx).alias("tx"))
    return t.select("tile_idx", "ty", "tx", (F.col("tx") * tile_w).alias("x0"), (F.col("ty") * tile_h).alias("y0"), F.greatest((F.col("tx") + 1) * tile_w - width, F.lit(0)).alias("pad_x"), F.greatest((F.col("ty") + 1) * tile_h - height, F.lit(0)).alias("pad_y"))


def hysteresis_edges(plane: np.ndarray, low: float = 60.0, high: float = 120.0) -> np.ndarray:
    """Edge map of a grey plane: 3x3 gradients, thinned along their direction, kept where strong or joined to strong ones."""
    p = np.pad(plane.astype(float), 1, mode="reflect") if min(plane.shape) > 1 else np.pad(plane.astype(float), 1, mode="edge")
    down = p[:-2] + 2 * p[1:-1] + p[2:]
    across = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gx, gy = down[:, 2:] - down[:, :-2], across[2:] - across[:-2]
    size = np.abs(gx) + np.abs(gy)
    around = np.pad(size, 1)
    h, w = size.shape

    def at(dy: int, dx: int) -> np.ndarray:
        return around[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    slope = np.tan(np.pi / 8)
    flat, steep = np.abs(gy) < slope * np.abs(gx), np.abs(gx) < slope * np.abs(gy)
    rising = gx * gy >= 0
    before = np.select([flat, steep, rising], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    after = np.select([flat, steep, rising], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    thin = (size > before) & (size >= after) & (size > low)
    edge = thin & (size > high)
    while True:
        grown = np.pad(edge, 1)
        near = np.zeros_like(edge)
        for dy in range(3):
            for dx in range(3):
                near |= grown[dy : dy + h, dx : dx + w]
        new = thin & near
        if (new == edge).all():
            return edge
        edge = new


def hysteresis_density(pixels: DataFrame) -> DataFrame:
    """(image_id, edge_density): share of edge pixels; a task holds one picture's grey plane at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        plane = pdf["v"].to_numpy().reshape(int(pdf["y"].max()) + 1, -1)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[:1], "edge_density": [hysteresis_edges(np.round(plane)).mean()]})

    return pixels.select("image_id", "y", "x", grey(F.col("r"), F.col("g"), F.col("b")).alias("v")).groupBy("image_id").applyInPandas(run, "image_id int, edge_density double")


def jittered(l: Column, strength: float, seed: int, *keys: Column) -> Column:
    """L scaled by a factor of 1 - 0.3 x strength to 1 + 0.7 x strength that depends on the seed and keys only."""
    return l * (1 + (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1001)) - 300) / 1000.0 * strength)
