"""Whole pictures, one pass each: normalising, all features, library builds."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.output import cover_crop
from gridloom.operators.library import first_of_content
from gridloom.operators.pixels import GREY, RGB_XYZ, WHITE, hysteresis_edges
from gridloom.operators.ranking import spread_rank
from gridloom.session import cut
from gridloom.sinks.raster import png_stream
from gridloom.sources.images import EXTENSIONS

# Version of the features made here, and side lengths of the grid and of the grey thumbnail.
VERSION, GRID, TINY = 5, 8, 16

FEATURES = (
    "avg_l double, avg_a double, avg_b double, mean_brightness double, std_brightness double, contrast double, saturation double, "
    "color_variance double, grid4x4 array<float>, tiny array<int>, edge_density double, hist array<float>"
)


def _shares(old: int, new: int) -> np.ndarray:
    """Matrix (new x old) of one axis of a resize: overlaps with each new pixel when shrinking, linear when enlarging."""
    if new <= old:
        ends = np.arange(new + 1) * (old / new)
        at = np.arange(old)
        part = np.minimum(ends[1:, None], at + 1) - np.maximum(ends[:-1, None], at)
        return np.clip(part, 0, None) * (new / old)
    place = np.clip((np.arange(new) + 0.5) * (old / new) - 0.5, 0, old - 1)
    low = np.minimum(place.astype(int), max(old - 2, 0))
    made = np.zeros((new, old))
    made[np.arange(new), low] = 1 - (place - low)
    made[np.arange(new), np.minimum(low + 1, old - 1)] += place - low
    return made


def resized(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """picture (height x width x channels) in another size: means of the areas covered, or linear between pixels."""
    if picture.shape[:2] == (height, width):
        return picture
    rows = np.tensordot(_shares(picture.shape[0], height), picture.astype(float), (1, 0))
    return np.rint(np.tensordot(_shares(picture.shape[1], width), rows, (1, 1)).swapaxes(0, 1)).clip(0, 255).astype(np.uint8)


def covered(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """picture scaled to cover width x height, cropped in the middle."""
    w, h, left, top = cover_crop(picture.shape[1], picture.shape[0], width, height)
    return resized(picture, w, h)[top : top + height, left : left + width]


def lab_plane(bgr: np.ndarray) -> np.ndarray:
    """L (0..255), a and b (128 = neutral) of every pixel."""
    c = bgr[..., ::-1].astype(float) / 255
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92) * 100
    v = linear @ np.array(RGB_XYZ).T / np.array(WHITE)
    f = np.where(v > 0.008856, np.cbrt(v), 7.787 * v + 16 / 116)
    return np.stack([(116 * f[..., 1] - 16) * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)


def grid_of(lab: np.ndarray, side: int = GRID) -> np.ndarray:
    """Cell means, rows and columns beyond whole cells left out; zeros for pictures smaller than the grid."""
    h, w = lab.shape[0] // side, lab.shape[1] // side
    if not h or not w:
        return np.zeros(side * side * 3)
    return lab[: h * side, : w * side].reshape(side, h, side, w, 3).mean((1, 3)).ravel()


def pattern_shares(grey: np.ndarray) -> np.ndarray:
    """Shares of the 256 local binary patterns of the inner pixels; zeros where there are none."""
    h, w = grey.shape
    if h < 3 or w < 3:
        return np.zeros(256)
    code = np.zeros((h - 2, w - 2), int)
    for bit, (dy, dx) in enumerate(((0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0))):
        code |= (grey[dy : dy + h - 2, dx : dx + w - 2] >= grey[1:-1, 1:-1]).astype(int) << bit
    return np.bincount(code.ravel(), minlength=256) / code.size


def features(bgr: np.ndarray) -> dict:
    """All features of a picture (height x width x BGR), from one look at its pixels."""
    lab = lab_plane(bgr)
    grey = bgr[..., 2] * GREY[0] + bgr[..., 1] * GREY[1] + bgr[..., 0] * GREY[2]
    top, low = bgr.max(-1).astype(float), bgr.min(-1).astype(float)
    mean = lab.mean((0, 1))
    return {
        "avg_l": mean[0], "avg_a": mean[1], "avg_b": mean[2], "mean_brightness": grey.mean(), "std_brightness": grey.std(), "contrast": grey.std() / 255,
        "saturation": float(np.divide(top - low, top, out=np.zeros_like(top), where=top > 0).mean() * 255), "color_variance": lab[..., 1].var() + lab[..., 2].var(),
        "grid4x4": grid_of(lab).tolist(), "tiny": resized(np.rint(grey)[..., None].astype(np.uint8), TINY, TINY).ravel().astype(int).tolist(),
        "edge_density": hysteresis_edges(np.rint(grey)).mean(), "hist": pattern_shares(np.rint(grey)).tolist(),
    }


def features_of_pixels(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height, features) of pixel tables (image_id, y, x, b, g, r): a task holds one picture at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        height, width = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        made = features(pdf[["b", "g", "r"]].to_numpy(np.uint8).reshape(height, width, 3))
        return pd.DataFrame([{"image_id": pdf["image_id"].iloc[0], "width": width, "height": height} | made])

    return pixels.groupBy("image_id").applyInPandas(run, f"image_id int, width int, height int, {FEATURES}")


def decoded(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, width, height, channels, data) of a folder's image files; undecodable ones have channels -1."""
    raw = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("image.*")
    known = F.lower(F.regexp_extract("origin", r"\.([^./\\]+)$", 1)).isin(*EXTENSIONS)
    return raw.where(known).select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data")


def _bgr(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


def extracted(pictures: DataFrame, width: int, height: int, store: str) -> DataFrame:
    """(path, ok, src_width, src_height, file_hash, file_path, file_size, features): each picture is normalised, its features taken
    and its PNG written under its content's name in the folder `store` (shared by all tasks), in one pass without a shuffle.

    Copies of a content write the same file. Undecodable pictures have ok = false and nulls."""
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(store, exist_ok=True)
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.channels not in (1, 3, 4) or not r.data:
                    rows.append({"path": r.path, "ok": False})
                    continue
                picture = covered(_bgr(r.data, r.width, r.height, r.channels), width, height)
                name = xxhash.xxh3_64_intdigest(picture.tobytes())
                place = f"{store}/{name}.png"
                data = b"".join(png_stream((line.tobytes() for line in picture[:, :, ::-1]), width, height, 6))
                temp = f"{store}/.{name}.{os.getpid()}"
                with open(temp, "wb") as out:
                    out.write(data)
                os.replace(temp, place)
                rows.append({"path": r.path, "ok": True, "src_width": r.width, "src_height": r.height, "file_hash": str(name), "file_path": place, "file_size": len(data)} | features(picture))
            if rows:
                yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    schema = f"path string, ok boolean, src_width int, src_height int, file_hash string, file_path string, file_size bigint, {FEATURES}"
    names = [c.split()[0] for c in schema.split(", ")]
    return pictures.mapInPandas(run, schema)


def build_library(spark: SparkSession, folder: str, out: str, width: int = 180, height: int = 320, recursive: bool = True, append: bool = False) -> dict:
    """Builds or extends the library in the folder `out` (tables images and meta, files under pictures) from a folder of pictures.

    Of equal contents the first path comes in, and none that the library holds; files are named by content, so no numbering
    pass moves pixels. Ids go on from the largest there is, in the order of the paths. Returns counts, seconds and pictures
    a second. Raises ValueError if there are no supported images, or the library exists and append is not asked for.
    """
    began = time.time()
    images = f"{out}/images.parquet"
    old = spark.read.parquet(images) if os.path.exists(images) else None
    if old is not None and not append:
        raise ValueError("library exists; append or choose another folder")
    found = decoded(spark, folder, recursive)
    if not found.select("path").take(1):
        raise ValueError("no supported images found")
    made = cut(extracted(found, width, height, f"{out}/pictures"))
    counts = made.agg(F.count("*").alias("found"), F.count_if(~F.col("ok")).alias("unreadable")).first()
    fresh = first_of_content(made.where("ok").drop("ok"), "file_hash", ["path"])
    last = 0
    if old is not None:
        fresh = fresh.join(old.select("file_hash"), "file_hash", "left_anti")
        last = old.agg(F.max("id")).first()[0] or 0
    rows = spread_rank(fresh.withColumn("_all", F.lit(0)), ["_all"], [F.col("path")], "_rank")
    rows = rows.select(
        (F.col("_rank") + last).cast("bigint").alias("id"), "file_path", "file_hash", F.lit("png").alias("format"), "src_width", "src_height", (F.col("src_width") / F.col("src_height")).alias("aspect_ratio"), "file_size",
        *[c.split()[0] for c in FEATURES.split(", ")], F.lit(0).alias("use_count"), F.lit(VERSION).alias("feature_version"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"),
    )
    rows = cut(rows)
    rows.write.mode("append").parquet(images)
    spark.createDataFrame([("feature_w", str(width)), ("feature_h", str(height))], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{out}/meta.parquet")
    added, seconds = rows.count(), time.time() - began
    return {"found": counts.found, "added": added, "unreadable": counts.unreadable, "duplicates": counts.found - counts.unreadable - added, "total": spark.read.parquet(images).count(), "seconds": round(seconds, 3), "per_second": round(counts.found / seconds, 1)}
