"""From picture files to a library and a mosaic, and its parts against plain arithmetic."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import library, mosaic, pictures
from gridloom.plans import rasters
from gridloom.sinks.raster import png_stream


def save(path, bgr):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(b"".join(png_stream((r.tobytes() for r in np.ascontiguousarray(bgr[:, :, ::-1])), bgr.shape[1], bgr.shape[0])))


def picture(i):
    a = np.empty((128, 72, 3), np.uint8)
    a[:] = rasters.COLOURS[i]
    a[20 + i : 50, 10:40] = 255 - np.array(rasters.COLOURS[i])
    a[100, 5:60] = 255
    return a


@pytest.fixture(scope="module")
def work(tmp_path_factory, spark):
    root = str(tmp_path_factory.mktemp("mosaic"))
    for i in range(10):
        save(f"{root}/in/{i}.png", picture(i))
    save(f"{root}/in/copy of 3.PNG", picture(3))
    with open(f"{root}/in/broken.png", "wb") as out:
        out.write(b"not a picture")
    with open(f"{root}/in/notes.txt", "w") as out:
        out.write("x")
    target = np.empty((64, 36, 3), np.uint8)
    target[:32, :18], target[:32, 18:], target[32:, :18], target[32:, 18:] = (40, 40, 220), (40, 190, 40), (220, 70, 40), (220, 220, 220)
    save(f"{root}/target.png", target)
    return root, pictures.build_library(spark, f"{root}/in", f"{root}/lib", 36, 64)


def test_build(work, spark):
    root, done = work
    assert {k: done[k] for k in ("found", "added", "unreadable", "duplicates", "total")} == {"found": 12, "added": 10, "unreadable": 1, "duplicates": 1, "total": 10}
    images = spark.read.parquet(f"{root}/lib/images.parquet")
    rows = {r.id: r for r in images.collect()}
    assert sorted(rows) == list(range(1, 11)) and all(os.path.exists(r.file_path) and len(r.grid4x4) == 192 and len(r.tiny) == 256 and abs(sum(r.hist) - 1) < 1e-5 for r in rows.values())
    assert {r.key: r.value for r in spark.read.parquet(f"{root}/lib/meta.parquet").collect()} == {"feature_w": "36", "feature_h": "64"}
    assert library.library_stats(images).first().total == 10
    want = pictures.features(pictures.resized(picture(0), 36, 64))
    first = rows[1]
    assert abs(first.avg_l - want["avg_l"]) < 1e-9 and first.tiny == want["tiny"] and (first.src_width, first.src_height) == (72, 128)
    with pytest.raises(ValueError, match="no supported images found"):
        os.makedirs(f"{root}/empty", exist_ok=True)
        pictures.build_library(spark, f"{root}/empty", f"{root}/lib2")
    with pytest.raises(ValueError, match="exists"):
        pictures.build_library(spark, f"{root}/in", f"{root}/lib", 36, 64)


def test_append_build(work, spark, tmp_path):
    _, out = work[0], str(tmp_path / "lib")
    for i in range(3):
        save(str(tmp_path / f"a/{i}.png"), picture(i))
    for i in range(5):
        save(str(tmp_path / f"b/{i}.png"), picture(i))
    assert pictures.build_library(spark, str(tmp_path / "a"), out, 36, 64)["added"] == 3
    more = pictures.build_library(spark, str(tmp_path / "b"), out, 36, 64, append=True)
    assert (more["added"], more["duplicates"], more["total"]) == (2, 3, 5)
    assert sorted(r.id for r in spark.read.parquet(f"{out}/images.parquet").collect()) == [1, 2, 3, 4, 5]


def test_mosaic(work, spark):
    root, _ = work
    path = f"{root}/out.png"
    got = mosaic.make_mosaic(spark, f"{root}/target.png", f"{root}/lib", path, 9, 16, 18, 32, native_w=18, native_h=32, candidates=4, top=1, adaptive=True)
    assert (got["width"], got["height"], got["tiles"], got["matched"], got["format"]) == (36, 64, 4, 4, "png") and not got["warnings"]
    made = pictures.decoded(spark, path).first()
    assert (made.width, made.height) == (36, 64)
    # Each quadrant is the chosen picture, and the choice is the least of all five-feature scores.
    images = {r.id: r for r in spark.read.parquet(f"{root}/lib/images.parquet").collect()}
    chosen = {r.tile: r.image_id for r in spark.read.parquet(f"{path}.winners").collect()}
    out = np.frombuffer(made.data, np.uint8).reshape(64, 36, 3)
    for tile, i in chosen.items():
        stored = pictures.decoded(spark, images[i].file_path).first()
        part = pictures.resized(np.frombuffer(stored.data, np.uint8).reshape(64, 36, 3), 18, 32)
        y, x = divmod(int(tile), 2)
        assert (out[y * 32 : y * 32 + 32, x * 18 : x * 18 + 18] == part).all()
    base = {i: rasters.COLOURS.index(min(rasters.COLOURS, key=lambda c: abs(np.array(c) - picture_mean).sum())) for i, picture_mean in ((i, _mean(spark, images[i].file_path)) for i in chosen.values())}
    assert [base[chosen[t]] for t in range(4)] == [2, 3, 4, 1]
    with pytest.raises(ValueError, match="outputPath is a directory"):
        mosaic.make_mosaic(spark, f"{root}/target.png", f"{root}/lib", root)


def _mean(spark, path):
    r = pictures.decoded(spark, path).first()
    return np.median(np.frombuffer(r.data, np.uint8).reshape(-1, 3), axis=0)


def test_resize_is_an_area_mean():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (12, 8, 3)).astype(np.uint8)
    assert (pictures.resized(a, 4, 4) == np.rint(a.reshape(4, 3, 4, 2, 3).mean((1, 3)))).all()
    assert pictures.resized(a, 8, 12) is a and pictures.resized(a, 3, 5).shape == (5, 3, 3)
    flat = np.full((5, 7, 3), 77, np.uint8)
    assert (pictures.resized(flat, 3, 2) == 77).all() and (pictures.resized(flat, 20, 11) == 77).all()
    assert pictures.covered(a, 6, 6).shape == (6, 6, 3)


def test_tiles_are_filled_by_mirroring(spark):
    a = np.random.default_rng(2).integers(0, 256, (20, 21, 3)).astype(np.uint8)
    got = {r.tile: r for r in mosaic.target_tiles(spark, a, 9, 16).collect()}
    whole = np.pad(a, ((0, 12), (0, 6), (0, 0)), mode="symmetric")
    assert sorted(got) == list(range(6))
    for t, r in got.items():
        want = pictures.features(whole[t // 3 * 16 : t // 3 * 16 + 16, t % 3 * 9 : t % 3 * 9 + 9])
        assert abs(r.avg_l - want["avg_l"]) < 1e-9 and np.allclose(r.grid4x4, want["grid4x4"], atol=1e-3)


def test_five_feature_score(spark):
    rng = np.random.default_rng(3)
    shots = [pictures.features(rng.integers(0, 256, (32, 32, 3)).astype(np.uint8) if i % 2 else np.full((32, 32, 3), 40 * i, np.uint8)) for i in range(6)]
    rows = [(i, j, {f"t_{k}": x for k, x in shots[i].items()} | shots[j] | {"use_count": j}) for i in range(6) for j in range(6)]
    schema = "i int, j int, " + ", ".join(f"t_{c}" for c in pictures.FEATURES.split(", ")) + ", " + pictures.FEATURES + ", use_count int"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in (i, j, *[d[n] for n in names[2:]])) for i, j, d in rows], schema)
    got = {(r.i, r.j): r for r in mosaic.scored(df).collect()}
    plain = {(r.i, r.j): r.score for r in mosaic.scored(df, adaptive=False).collect()}
    cell = np.array(mosaic.v.CELL_WEIGHTS)
    for i, j, _ in rows:
        a, b = shots[i], shots[j]
        d = [
            np.sqrt(sum((a[c] - b[c]) ** 2 for c in ("avg_l", "avg_a", "avg_b"))) / 100,
            (np.sqrt(((np.float32(a["grid4x4"]).astype(float) - np.float32(b["grid4x4"])).reshape(64, 3) ** 2).sum(1)) * cell).sum() / 6400,
            ((np.array(a["tiny"]) - b["tiny"]) ** 2).sum() / (256 * 255.0**2), abs(a["edge_density"] - b["edge_density"]), np.abs(np.array(a["hist"]) - b["hist"]).sum() / 2,
        ]
        kind = got[i, j].category
        w = np.array(mosaic.v.CATEGORY_WEIGHTS[kind])
        assert abs(got[i, j].score - (w * d).sum() / w.sum() - 0.01 * j) < 1e-6
        assert abs(plain[i, j] - (np.array(mosaic.WEIGHTS) * d).sum() - 0.01 * j) < 1e-6
    assert {got[i, 0].category for i in range(6)} >= {"smooth", "edge"}


def test_one_pass_equals_pixel_tables(spark):
    one = {r.image_id: r for r in pictures.features_of_pixels(rasters.raster(spark)).collect()}
    from gridloom.operators import pixels as px

    edges = {r.image_id: r.edge_density for r in px.hysteresis_density(rasters.raster(spark)).collect()}
    cells = {(r.image_id, r.cell): (r.l, r.a, r.b) for r in px.grid_cells(rasters.raster(spark)).collect()}
    for i, r in one.items():
        assert abs(r.edge_density - edges[i]) < 1e-9
        assert np.allclose(np.reshape(r.grid4x4, (64, 3)), [cells[i, c] for c in range(64)], atol=1e-3)


def test_health_and_unused_agree(spark):
    images = spark.createDataFrame([(i, f"/p/{i}", 40.0, 120.0, 130.0) for i in range(1, 9)], "id long, file_path string, avg_l double, avg_a double, avg_b double")
    usage = spark.createDataFrame([(1, 2, 9, None), (1, 2, 9, None), (1, 3, 10, None), (99, 5, 50, None), (None, 1, 1, None), (-4, 1, 1, None), (3, 1, 2, None)], "image_id long, total_runs int, total_tiles long, last_used timestamp_ntz")
    row = library.health_report(images, usage).first()
    assert (row.used, row.unused, row.used_pct, row.unused_pct) == (2, 6, 25.0, 75.0) and library.unused_images(images, usage).count() == row.unused
    assert row.advice == "mid,green_red,blue_yellow,unused" and row.warn_hotspot
    assert library.health_report(images.limit(0), usage).select(F.col("advice")).first().advice == ""
    names = {r.image_id: r.file_name for r in library.usage_export(usage, images).collect()}
    assert names[1] == "rank0002_3runs_10tiles_id1" and names[99] == "rank0001_5runs_50tiles_id99"
