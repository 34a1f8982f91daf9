"""Encoders, edge detection and the command line."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import pixels
from gridloom.plans.rasters import raster
from gridloom.sinks.raster import tiff_stream, write_encoded, write_tiff


def _tags(data: bytes) -> dict:
    at = struct.unpack("<I", data[4:8])[0]
    n = struct.unpack("<H", data[at : at + 2])[0]
    return {t: (form, count, value) for t, form, count, value in (struct.unpack("<HHII", data[at + 2 + 12 * i : at + 14 + 12 * i]) for i in range(n))}


def test_tiff(spark, tmp_path):
    one = raster(spark).where("image_id = 3")
    write_tiff(one, str(tmp_path / "a.tif"), 72, 128)
    data = (tmp_path / "a.tif").read_bytes()
    tags = _tags(data)
    assert (tags[256][2], tags[257][2], tags[273][1]) == (72, 128, 128)
    strips = struct.unpack("<128I", data[tags[273][2] : tags[273][2] + 512])
    rows = np.stack([np.frombuffer(data[s : s + 216], np.uint8) for s in strips]).reshape(128, 72, 3)
    want = {(r.y, r.x): (r.r, r.g, r.b) for r in one.collect()}
    assert all(tuple(rows[y, x]) == c for (y, x), c in want.items())
    jvm = spark.sparkContext._jvm
    for name, parts in (("one", tiff_stream([bytes([9, 8, 7])], 1, 1, False)), ("many", tiff_stream([bytes([9, 8, 7] * 2)] * 3, 2, 3, False))):
        (tmp_path / f"{name}.tif").write_bytes(b"".join(parts))
        picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / f"{name}.tif")))
        assert picture.getRGB(0, 0) & 0xFFFFFF == 0x090807
    big = b"".join(tiff_stream([bytes([1, 2, 3] * 2)] * 3, 2, 3, True))
    assert big[:4] == b"II\x2b\x00" and big.endswith(bytes([1, 2, 3] * 6))


def test_jpeg(spark, tmp_path):
    flat = raster(spark).where("image_id = 0").select("image_id", "y", "x", F.lit(200).alias("b"), F.lit(100).alias("g"), F.lit(50).alias("r"))
    write_encoded(flat, str(tmp_path / "a.jpg"), 72, 128)
    picture = spark.sparkContext._jvm.javax.imageio.ImageIO.read(spark.sparkContext._jvm.java.io.File(str(tmp_path / "a.jpg")))
    rgb = picture.getRGB(10, 10) & 0xFFFFFF
    assert (picture.getWidth(), picture.getHeight()) == (72, 128) and abs((rgb >> 16) - 50) < 6 and abs((rgb & 255) - 200) < 6


def test_edges():
    plane = np.zeros((20, 20))
    plane[:, 10:] = 200
    edge = pixels.hysteresis_edges(plane)
    assert edge.any(1).all() and edge.sum() == 20 and set(np.flatnonzero(edge.any(0))) <= {9, 10}
    assert not pixels.hysteresis_edges(np.full((8, 8), 77.0)).any() and pixels.hysteresis_edges(np.zeros((1, 1))).shape == (1, 1)
    weak = np.zeros((20, 20))
    weak[:, 10:] = 20  # gradient 80: weak everywhere, so no edge
    assert not pixels.hysteresis_edges(weak).any()
    weak[5, 10:] = 200
    assert pixels.hysteresis_edges(weak).any()


def test_jitter_repeats(spark):
    df = spark.range(200).select("id", pixels.jittered(F.lit(100.0), 0.1, 5, F.col("id")).alias("l"))
    a, b = df.collect(), df.repartition(3).orderBy("id").collect()
    assert a == b and 97 <= min(r.l for r in a) < max(r.l for r in a) <= 107


def test_command_line(spark, tmp_path, capsys):
    from gridloom.__main__ import main

    spark.createDataFrame([(1, 10.0, 1.0, 1.0, "a"), (2, 100.0, 1.0, 1.0, "b")], "id long, avg_l double, avg_a double, avg_b double, file_path string").write.parquet(str(tmp_path / "images.parquet"))
    assert main(["stats", str(tmp_path)]) == 0 and json.loads(capsys.readouterr().out.splitlines()[0])["total"] == 2
    assert main(["inspect", str(tmp_path), "--l", "15"]) == 0 and json.loads(capsys.readouterr().out)["n"] == 1
    assert main(["inspect", str(tmp_path)]) == 1 and main(["usage", str(tmp_path), "--limit", "0"]) == 1 and main(["usage", str(tmp_path)]) == 2


def test_jpeg_bytes_decode(spark, tmp_path):
    from gridloom.sinks.raster import jpeg_bytes

    rng = np.random.default_rng(1)
    y, x = np.mgrid[:45, :61]
    smooth = np.stack([x * 4 % 256, y * 5, (x + y) * 2], axis=-1).clip(0, 255).astype(np.uint8)
    for name, a, quality, most in (("s", smooth, 90, 6), ("n", rng.integers(0, 256, (16, 24, 3)).astype(np.uint8), 100, 4), ("one", np.full((1, 1, 3), 90, np.uint8), 50, 6)):
        (tmp_path / f"{name}.jpg").write_bytes(jpeg_bytes(a, quality))
        r = spark.read.format("image").load(str(tmp_path / f"{name}.jpg")).select("image.*").first()
        got = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)[:, :, ::-1]
        assert got.shape == a.shape and np.abs(got.astype(int) - a).mean() < most


def test_pyramid_of_jpegs(spark, tmp_path):
    from gridloom.sinks.raster import write_pyramid

    write_pyramid(raster(spark).where("image_id = 2"), str(tmp_path), "p", 72, 128, 32, "jpg")
    assert (tmp_path / "p_files/7/2_3.jpg").read_bytes()[:2] == b"\xff\xd8" and "p_files/${level}" in (tmp_path / "p.html").read_text() and 'Format="jpg"' in (tmp_path / "p.dzi").read_text()


def test_sqlite_in_slices(spark, tmp_path, monkeypatch):
    import sqlite3

    from gridloom.sources import images

    with sqlite3.connect(tmp_path / "l.db") as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i * 3, None if i % 5 == 0 else f"n{i}") for i in range(1, 40)])
        db.execute("CREATE TABLE none (id INTEGER)")
    monkeypatch.setattr(images, "SLICE", 10)
    got = sorted((r.id, r.name) for r in images.sqlite_table(spark, str(tmp_path / "l.db"), "t", "id bigint, name string").collect())
    assert got == [(i * 3, None if i % 5 == 0 else f"n{i}") for i in range(1, 40)] and images.sqlite_table(spark, str(tmp_path / "l.db"), "none", "id bigint").count() == 0


def test_build_and_mosaic_by_command_line(spark, tmp_path, capsys):
    from gridloom.__main__ import main
    from tests.test_end_to_end import picture, save

    for i in range(3):
        save(str(tmp_path / f"in/{i}.png"), picture(i))
    lib = str(tmp_path / "lib")
    assert main(["build", "--input", str(tmp_path / "in"), "--output", lib, "--normalizeSize", "36x64"]) == 0
    assert main(["mosaic", "--input", str(tmp_path / "in/1.png"), "--db", lib, "--output", str(tmp_path / "o.png"), "--outputTile", "9x16", "--tileW", "36", "--tileH", "64", "--adaptiveWeights"]) == 0
    assert main(["db-stats", "--db", lib]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["stats"]["total"] == 3
    assert main(["db-usage", "--limit", "0"]) == 1 and main(["mosaic", "--nope", "1"]) == 1 and main(["db-health", "--db", str(tmp_path / "none")]) == 2


def test_lzw(spark, tmp_path):
    from gridloom.sinks.raster import png_bytes, tiff_lzw

    rng = np.random.default_rng(5)
    wide = np.concatenate([rng.integers(0, 256, (2, 9000, 3)), np.zeros((1, 9000, 3))]).astype(np.uint8)
    jvm = spark.sparkContext._jvm
    for name, a in (("wide", wide), ("one", np.full((1, 1, 3), 7, np.uint8)), ("small", rng.integers(0, 4, (40, 30, 3)).astype(np.uint8))):
        for kind, data in (("tif", tiff_lzw(a)), ("png", png_bytes(a))):
            (tmp_path / f"{name}.{kind}").write_bytes(data)
            picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / f"{name}.{kind}")))
            assert (picture.getWidth(), picture.getHeight()) == (a.shape[1], a.shape[0])
            for y, x in ((0, 0), (a.shape[0] - 1, a.shape[1] - 1), (a.shape[0] // 2, a.shape[1] // 3), (0, a.shape[1] - 1)):
                assert picture.getRGB(x, y) & 0xFFFFFF == int(a[y, x, 0]) << 16 | int(a[y, x, 1]) << 8 | int(a[y, x, 2])


def test_output_rules():
    import pytest

    from gridloom.functions.output import checked_sides, export_name, streams

    assert not streams(100, 100, "png") and streams(30_000, 30_000, "png") and not streams(30_000, 30_000, "png", free_bytes=2**40) and streams(30_000, 30_000, "png", "stream", 2**40) and not streams(30_000, 30_000, "webp")
    assert checked_sides(5, 6) == (5, 6) and export_name(7, 1, 2, 3, ".png") == "rank0007_1runs_2tiles_id3.png" and export_name(12345678, 1, 2, 3, "").startswith("rank12345678_")
    with pytest.raises(ValueError):
        checked_sides(2**30, 5)
