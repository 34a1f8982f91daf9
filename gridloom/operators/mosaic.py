"""A picture rebuilt from a library's pictures: tiles, candidates, five-feature scores, the choice, and the pasted result."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import vectors as v
from gridloom.functions.output import checked_sides, fitted, output_format
from gridloom.operators import nearest, selector
from gridloom.operators.pictures import FEATURES, _bgr, decoded, features, lab_plane, resized
from gridloom.session import cut
from gridloom.sinks.raster import png_stream, tiff_stream
from gridloom.sinks.report import write_report

# Weights of colour, layout, thumbnail, edges and texture where they don't follow the tile's category.
WEIGHTS = (0.20, 0.45, 0.25, 0.05, 0.05)
USE_PENALTY, REPEAT_PENALTY = 0.01, 100.0
FEATURE_NAMES = [c.split()[0] for c in FEATURES.split(", ")]


def target_hash(data: bytes, samples: int = 10_000) -> str:
    """A short name of a target's pixels: up to `samples` bytes at even steps, shifted and added up to 64 bits, in hex."""
    a = np.frombuffer(data, np.uint8)[:: max(1, len(data) // samples)]
    h = len(data) & (2**64 - 1)
    for byte in a.tolist():
        h ^= (byte + 0x9E3779B9 + (h << 6) + (h >> 2)) & (2**64 - 1)
    return f"{h:x}"


def prepared(picture: np.ndarray, out_w: int = 0, out_h: int = 0, upscale: int = 0) -> np.ndarray:
    """The target in the size that is cut into tiles: resized if a size is asked for, then enlarged."""
    if out_w > 0 and out_h > 0:
        picture = resized(picture, out_w, out_h)
    return resized(picture, picture.shape[1] * upscale, picture.shape[0] * upscale) if upscale > 1 else picture


def target_tiles(spark: SparkSession, picture: np.ndarray, tile_w: int, tile_h: int) -> DataFrame:
    """(tile, ty, tx, features): the target in whole tiles, its last rows and columns mirrored outwards to fill them.

    Only bands of a tile's height leave the driver; each task cuts its bands and takes the tiles' features."""
    ny, nx = -(-picture.shape[0] // tile_h), -(-picture.shape[1] // tile_w)
    whole = np.pad(picture, ((0, ny * tile_h - picture.shape[0]), (0, nx * tile_w - picture.shape[1]), (0, 0)), mode="symmetric")
    bands = [(ty, bytearray(whole[ty * tile_h : (ty + 1) * tile_h].tobytes())) for ty in range(ny)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                band = np.frombuffer(r.data, np.uint8).reshape(tile_h, nx, tile_w, 3)
                yield pd.DataFrame([{"tile": r.ty * nx + tx, "ty": r.ty, "tx": tx} | features(band[:, tx]) for tx in range(nx)])

    made = spark.createDataFrame(bands, "ty int, data binary").repartition(min(ny, spark.sparkContext.defaultParallelism), "ty")
    return made.mapInPandas(run, f"tile bigint, ty int, tx int, {FEATURES}")


def _vector() -> Column:
    """The 196 numbers candidates are found by."""
    return F.concat(F.array(F.col("avg_l") / 255, F.col("avg_a") / 255, F.col("avg_b") / 255), F.transform("grid4x4", lambda x: x.cast("double") / 255), F.array("edge_density"))


def scored(pairs: DataFrame, adaptive: bool = True, weights: tuple[float, ...] = WEIGHTS, use_penalty: float = USE_PENALTY) -> DataFrame:
    """pairs with the five distances, the tile's category and the score.

    pairs: a tile's features under t_..., a library row's under their own names, and use_count. Weights follow the tile's
    category if adaptive, else they are the given ones; either way they are divided by their sum. Missing or short
    thumbnails and histograms count as the largest distance."""
    got = pairs.select(
        "*", v.lab_distance(F.col("t_avg_l"), F.col("t_avg_a"), F.col("t_avg_b"), F.col("avg_l"), F.col("avg_a"), F.col("avg_b")).alias("d_lab"),
        v.grid_distance(F.col("t_grid4x4"), F.col("grid4x4")).alias("d_grid"), v.tiny_error(F.col("t_tiny"), F.col("tiny")).alias("d_tiny"),
        F.abs(F.col("t_edge_density") - F.col("edge_density")).alias("d_edge"), v.histogram_distance(F.col("t_hist"), F.col("hist")).alias("d_texture"),
        v.category(F.col("t_edge_density"), v.variance(v.channel(F.col("t_grid4x4"), 0)), v.entropy(F.col("t_hist"))).alias("category"),
    )
    w = v.category_weights(F.col("category")) if adaptive else F.array(*[F.lit(float(x)) for x in weights])
    got = got.withColumn("_w", w)
    total = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
    parts = sum((F.col("_w")[i] * F.col(c) for i, c in enumerate(("d_lab", "d_grid", "d_tiny", "d_edge", "d_texture"))), F.lit(0.0))
    return got.withColumn("score", parts / total + F.coalesce("use_count", F.lit(0)) * use_penalty).drop("_w")


def scored_candidates(library: DataFrame, tiles: DataFrame, candidates: int, **how) -> DataFrame:
    """Every tile's nearest library rows by the 196 numbers, scored."""
    rows, asked = library.select("id", _vector().alias("vec")), tiles.select(F.col("tile").alias("q"), _vector().alias("vec"))
    near = nearest.knn(rows, asked, candidates).select(F.col("q").alias("tile"), "id", F.col("rank").alias("ann_rank"))
    left = tiles.select("tile", *[F.col(c).alias(f"t_{c}") for c in FEATURE_NAMES])
    return scored(near.join(left, "tile").join(library.select("id", "use_count", "file_path", *FEATURE_NAMES), "id"), **how)


def jittered_picture(bgr: np.ndarray, factor: float) -> np.ndarray:
    """The picture with its lightness scaled; colours keep their ratio, so no way back from LAB is needed."""
    lab = lab_plane(bgr)[..., :1]
    scale = np.clip(lab * factor, 0, 255) / np.maximum(lab, 1)
    return np.rint(np.clip(bgr * scale, 0, 255)).astype(np.uint8)


def pasted(winners: DataFrame, pictures: DataFrame, nx: int, native_w: int, native_h: int, strength: float = 0.0, seed: int = 0) -> DataFrame:
    """(ty, data): the RGB rows of each band of the result. winners: (tile, image_id); pictures: (image_id, width, height, channels, data).

    A task holds one band: a tile's height times the result's width. Tiles without a winner stay black."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band = np.zeros((native_h, nx, native_w, 3), np.uint8)
        made: dict[int, np.ndarray] = {}  # images of the band in the tile's size, each made once
        for r in pdf.itertuples(index=False):
            if r.data is not None:
                if r.image_id not in made:
                    made[r.image_id] = resized(_bgr(r.data, r.width, r.height, r.channels), native_w, native_h)
                tile = made[r.image_id]
                if strength:
                    tile = jittered_picture(tile, 1 + ((int(r.tile) * 7919 + seed * 104_729) % 1001 - 300) / 1000 * strength)
                band[:, int(r.tile) % nx] = tile
        return pd.DataFrame({"ty": [int(pdf["tile"].iloc[0]) // nx], "data": [band.reshape(native_h, -1, 3)[:, :, ::-1].tobytes()]})

    both = winners.join(pictures, "image_id", "left").withColumn("ty", F.floor(F.col("tile") / nx).cast("int"))
    return both.groupBy("ty").applyInPandas(run, "ty int, data binary")


def write_bands(bands: DataFrame, path: str, width: int, band_h: int, ny: int, fmt: str, level: int = 1) -> None:
    """Streams the bands to a PNG or TIFF file; the driver holds one at a time, and bands that are missing are black."""
    line = width * 3

    def rows() -> Iterator[bytes]:
        at = 0
        for r in bands.repartitionByRange(max(1, ny), "ty").sortWithinPartitions("ty").toLocalIterator():
            while at < r.ty:
                yield from (bytes(line) for _ in range(band_h))
                at += 1
            data = bytes(r.data)
            yield from (data[i * line : (i + 1) * line] for i in range(band_h))
            at += 1
        while at < ny:
            yield from (bytes(line) for _ in range(band_h))
            at += 1

    temp = f"{path}.part"
    with open(temp, "wb") as out:
        for part in png_stream(rows(), width, band_h * ny, level) if fmt == "png" else tiff_stream(rows(), width, band_h * ny):
            out.write(part)
    os.replace(temp, path)


def make_mosaic(
    spark: SparkSession, target: str, library_folder: str, path: str, tile_w: int = 9, tile_h: int = 16, out_w: int = 0, out_h: int = 0, upscale: int = 0,
    native_w: int = 180, native_h: int = 320, candidates: int = 150, top: int = 10, window: int = 0, penalty: float = REPEAT_PENALTY, adaptive: bool = False,
    weights: tuple[float, ...] = WEIGHTS, use_penalty: float = USE_PENALTY, fmt: str | None = None, level: int = 1, strength: float = 0.0, seed: int = 0, report: bool = False,
) -> dict:
    """Rebuilds the target picture from the library in library_folder and writes it (PNG or TIFF) to path.

    Returns the size, the counts of tiles and distinct images, the target's hash, the seconds of each phase and warnings. The
    winners are left in <path>.winners as a table (tile, image_id, score), a report if asked for in <path>_analysis. Raises ValueError for a path that is a folder, a
    target that can't be read, or an empty library.
    """
    if os.path.isdir(path):
        raise ValueError("outputPath is a directory")
    seconds, clock = {}, time.time()

    def phase(name: str) -> None:
        nonlocal clock
        seconds[name], clock = round(time.time() - clock, 3), time.time()

    got = decoded(spark, target).take(1)
    if not got or got[0].channels not in (1, 3, 4):
        raise ValueError("target can't be read")
    picture = prepared(_bgr(bytes(got[0].data), got[0].width, got[0].height, got[0].channels), out_w, out_h, upscale)
    library = spark.read.parquet(f"{library_folder}/images.parquet")
    size = library.count()
    if not size:
        raise ValueError("library is empty")
    meta = {r.key: r.value for r in spark.read.parquet(f"{library_folder}/meta.parquet").collect()}
    warnings = []
    if meta.get("feature_w", "0") != "0" and abs(int(meta["feature_w"]) / int(meta["feature_h"]) - native_w / native_h) > 0.02:
        warnings.append("the library's aspect ratio differs from the tile's")
    ny, nx = -(-picture.shape[0] // tile_h), -(-picture.shape[1] // tile_w)
    phase("prepare")
    tiles = cut(target_tiles(spark, picture, tile_w, tile_h))
    phase("tiles")
    found = cut(scored_candidates(library, tiles, candidates, adaptive=adaptive, weights=weights, use_penalty=use_penalty))
    phase("score")
    asked = found.select(F.lit(0).cast("bigint").alias("run_id"), "tile", F.col("id").alias("image_id"), "score", F.col("grid4x4").alias("grid"))
    chosen = cut(selector.greedy_choice(asked, window or selector.auto_window(nx, size), tiles_x=nx, penalty=penalty, top=top, seed=seed))
    phase("choose")
    checked_sides(nx * native_w, ny * native_h)
    _, _, kind = fitted(nx * native_w, ny * native_h, output_format(path, fmt), bool(fmt))
    if kind not in ("png", "tiff"):
        kind = "tiff"
    used = chosen.select("image_id").distinct().join(library.select(F.col("id").alias("image_id"), "file_path"), "image_id")
    files = [r.file_path for r in used.select("file_path").take(1)]
    pictures = decoded(spark, os.path.dirname(files[0])) if files else decoded(spark, library_folder)
    named = pictures.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).join(used.withColumn("name", F.regexp_extract("file_path", r"([^/]+)$", 1)).select("name", "image_id"), "name")
    bands = pasted(chosen.select("tile", "image_id"), named.select("image_id", "width", "height", "channels", "data"), nx, native_w, native_h, strength, seed)
    write_bands(bands, path, nx * native_w, native_h, ny, kind, level)
    phase("paste")
    chosen.select("tile", "image_id", "score").write.mode("overwrite").parquet(f"{path}.winners")
    if report:
        write_report(found, chosen, f"{path}_analysis", nx, ny)
        phase("report")
    return {
        "width": nx * native_w, "height": ny * native_h, "format": kind, "tiles": nx * ny, "matched": chosen.count(), "images": used.count(), "target_hash": target_hash(picture.tobytes()),
        "seconds": seconds, "warnings": warnings,
    }
