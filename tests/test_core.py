"""Core functions and operators against known values and brute force."""

from __future__ import annotations

import random
import struct
import zlib
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import output, vectors as v
from gridloom.functions.content import hash_key, hash_value, location
from gridloom.functions.vectors import CELL_WEIGHTS
from gridloom.operators import analysis, library, nearest, pixels, selector
from gridloom.operators.components import components
from gridloom.operators.ranking import spread_rank
from gridloom.operators.references import orphan_counts, orphan_report
from gridloom.session import cut


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(values):
    return F.array(*[F.lit(float(x)) for x in values])


def test_distances(spark):
    d = one(spark, v.lab_distance(*[F.lit(x) for x in (0, 0, 0, 30, 40, 0)]), v.lab_distance(*[F.lit(x) for x in (0, 0, 0, 60, 60, 30)]), v.tiny_error(lit([0] * 256), lit([255] * 256)), v.tiny_error(lit([0] * 200), lit([0] * 256)))
    assert [round(x, 9) for x in d] == [0.5, 0.9, 1.0, 1.0]
    hot = [0.0] * 256
    hot[0] = 1.0
    assert one(spark, v.histogram_distance(lit(hot), lit(hot[::-1])))[0] == 1.0
    base = [0.0] * 192
    corner, centre = list(base), list(base)
    corner[0] = centre[27 * 3] = 100.0
    d = one(spark, v.grid_distance(lit(base), lit(base)), v.grid_distance(lit(base), lit(corner)), v.grid_distance(lit(base), lit(centre)), v.grid_distance(lit(base[:48]), lit(base)), v.plain_grid_distance(lit(base[:50]), lit(base[:50])))
    assert d[0] == 0 and d[2] > d[1] > 0 and d[3] == d[4] == v.BAD_GRID
    assert one(spark, v.grid_distance(F.lit(None).cast("array<double>"), lit(base)))[0] == v.BAD_GRID


def test_grid_resizing(spark):
    four = [float(i) for i in range(48)]
    up = one(spark, v.doubled(lit(four)), v.halved(v.doubled(lit(four))))
    assert list(up[0])[:6] == [0, 1, 2, 0, 1, 2] and list(up[0])[6:9] == [3, 4, 5] and list(up[0])[24:27] == [0, 1, 2]
    assert list(up[1]) == four


def test_patterns(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 255, (8, 8)).astype(float)
    want = []
    for y in range(1, 7):
        for x in range(1, 7):
            around = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
            want.append(sum(1 << i for i, (dy, dx) in enumerate(around) if p[y + dy, x + dx] >= p[y, x]))
    got = one(spark, v.pattern_codes(lit(p.ravel())), v.pattern_entropy(v.pattern_codes(lit(p.ravel()))), v.gradient_density(lit(p.ravel())))
    share = np.bincount(want, minlength=256) / 36
    assert list(got[0]) == want
    assert got[1] == pytest.approx(-(share[share > 0] * np.log2(share[share > 0])).sum())
    assert got[2] == ((np.abs(np.diff(p, axis=1))[1:] + np.abs(np.diff(p, axis=0))[:, 1:]) > 30).sum() / 64


def test_hash_notations(spark):
    same = ["0x811b0f08b0c9e5de", "-9143698088445483554", "009303045985264068062", " 9303045985264068062\t", "811B0F08B0C9E5DE", "+9303045985264068062"]
    none = ["", " ", "-", None, "zz", "99999999999999999999", "0x", "0x11112222333344445"]
    rows = spark.createDataFrame([(x,) for x in same + none], "h string").select(hash_value(F.col("h")).cast("string"), hash_key(F.col("h"))).collect()
    assert {tuple(r) for r in rows[: len(same)]} == {("9303045985264068062", -9143698088445483554)}
    assert all(r[0] is None and r[1] is None for r in rows[len(same) :])
    assert spark.createDataFrame([("0",), ("-0",), ("0x0",)], "h string").select(hash_key(F.col("h"))).distinct().collect()[0][0] == 0


def test_locations(spark):
    same = ["lib/harbour/a.jpg", " LIB\\harbour\\\\a.JPG\n", "./lib/x/../harbour/./a.jpg", "lib//harbour/tmp//../a.jpg"]
    apart = ["/lib/harbour/a.jpg", "lib/harbour/b.jpg", "lib/harbour/a.png", "../lib/harbour/a.jpg", "lib/harbour-a.jpg"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [*same, *apart, "café/x", "CAFÉ/X", None, "  "]], "p string").select(location(F.col("p"))).collect()]
    assert len(set(got[:4])) == 1 and len(set(got[:9])) == 6 and got[9] == got[10] and got[11] is None and got[12] is None


def test_ranks(spark):
    rows = [(i % 3 if i % 7 else None, i // 2, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, id long")
    got = {r.id: r.r for r in spread_rank(df, ["g"], [F.desc("o"), F.col("id")], "r").collect()}
    for g in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            assert got[r[2]] == i
    assert spread_rank(df.limit(0), ["g"], [F.col("id")]).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for x in parent}
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_orphans(spark):
    parents = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    child = spark.createDataFrame([(1, "2024-01-05"), (3, "2024-01-05"), (3, "2024-01-09"), (3, None), (-4, None), (None, "2024-02-01"), (9, "2024-02-01")], "k long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {tuple(r) for r in orphan_counts(parents, "id", [("c", child, "k", "t")]).select("src_table", "period", "image_id", "n").collect()}
    assert got == {("c", "2024-01", 3, 2), ("c", "none", 3, 1), ("c", "2024-02", 9, 1)}
    assert orphan_report(parents, "id", [("c", child.limit(0), "k", "t")]).count() == 0
    assert orphan_counts(parents.limit(0), "id", [("c", child, "k", "t")]).count() == 4


def test_index_percentiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), round(rng.random(), 2)) for _ in range(400)] + [("a", None)]
    got = {r.g: r for r in analysis.index_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in ("a", "b", None):
        s = sorted(x for k, x in rows if k == g and x is not None)
        assert (got[g].n, got[g].median, got[g].p90, got[g].p99) == (len(s), s[len(s) // 2], s[len(s) * 9 // 10], s[len(s) * 99 // 100])


@pytest.mark.parametrize("metric", nearest.METRICS)
def test_knn(spark, metric):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[7] = x[9] = x[8]
    rows = spark.createDataFrame([(i, [float(a) for a in r], i % 5) for i, r in enumerate(x)] + [(900, None, 1), (901, [1.0], 1)], "id long, vec array<float>, label int")
    asked = rows.where("id < 20").select(F.col("id").alias("q"), "vec")
    y = x.astype(float)
    d = {"l2": lambda a: np.sqrt(((y - a) ** 2).sum(1)), "ip": lambda a: 1 - y @ a, "cosine": lambda a: 1 - y @ a / np.sqrt((y**2).sum(1) * (a**2).sum())}[metric]
    got: dict = {}
    for r in nearest.knn(rows, asked, 5, metric).collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.id, r.distance)
    for q in range(20):
        s = d(y[q])
        order = [i for i in np.lexsort((np.arange(300), np.round(s, 9))) if i != q][:5]
        assert [round(got[q][k + 1][1], 6) for k in range(5)] == [round(float(s[i]), 6) for i in order]
    assert nearest.knn(rows, asked.limit(0), 5, metric).count() == 0


def test_knn_documents(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(a) for a in r], int(i % 40 if i < 120 else 50)) for i, r in enumerate(x)], "id long, vec array<float>, label int")
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("q"), "vec")
    got: dict = {}
    for r in nearest.knn_documents(rows, asked, "label", 2).collect():
        got.setdefault(r.q, set()).add(r.id)
    for q in (0, 50, 100, 150):
        s = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        seen, want = [], set()
        for i in np.argsort(s, kind="stable"):
            if i == q:
                continue
            lab = i % 40 if i < 120 else 50
            if lab not in seen:
                if len(seen) == 2:
                    break
                seen.append(lab)
            want.add(int(i))
        assert got[q] == want


def test_cell_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(rng.normal(size=(120, 8)))], "id long, vec array<float>")
    index = nearest.CellIndex.build(rows, 4)
    asked = rows.where("id < 5").select(F.col("id").alias("q"), "vec")
    exact = nearest.knn(rows, asked, 3).orderBy("q", "rank").select("q", "id").collect()
    assert index.search(asked, 3, 4).orderBy("q", "rank").select("q", "id").collect() == exact
    index.save(str(tmp_path / "i"))
    again = nearest.CellIndex.load(spark, str(tmp_path / "i"))
    assert again.vector(rows.where("id = 3")).count() == 1
    gone = again.mark_deleted(spark.createDataFrame([(exact[0].id,)], "id long"))
    assert exact[0].id not in {r.id for r in gone.search(asked, 3, 4).collect()}


def _spec(tiles, window, tiles_x, penalty):
    recent, freq, last, grids, out = deque(), {}, {}, deque(maxlen=50), []
    w = np.repeat(np.array(v.CELL_WEIGHTS), 3)
    for t, cands in sorted(tiles.items()):
        best = None
        for image, score, grid in sorted(cands, key=lambda c: c[0]):
            s = score + penalty * {0: 0, 1: 0.1, 2: 0.4}.get(freq.get(image, 0), 1.0)
            if image in last and t - last[image] < max(50, tiles_x):
                s += 500
            if any(((np.array(grid) - g) ** 2 * w).sum() / 6400 < 0.010 for g in grids):
                s += 200
            if best is None or s < best[0]:
                best = (s, image, grid)
        s, image, grid = best
        out.append((t, image))
        recent.append(image)
        freq[image] = freq.get(image, 0) + 1
        if len(recent) > window:
            freq[recent.popleft()] -= 1
        last[image] = t
        grids.append(np.array(grid))
    return out


def test_bounded_scores_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    cell, weights = np.array(CELL_WEIGHTS), (0.3, 0.6, 0.1)
    scenes = rng.uniform(0, 255, (12, 64, 3))
    g = np.clip(scenes[rng.integers(0, 12, 900)] + rng.normal(0, 6, (900, 64, 3)), 0, 255)
    x, ids, penalty = rng.uniform(0, 255, (900, 4)), np.arange(900)[::-1].copy(), rng.integers(0, 4, 900) * 0.01
    g[5], x[5], penalty[5] = g[6], x[6], penalty[6]
    grid, side, own = g[:40], x[:40], ids[:40]
    top, who = np.full(40, np.inf), np.full(40, -1)
    scored = sum(selector.better_rows(top, who, own, side, grid, selector._coarse(grid, cell), ids[s], x[s], g[s], penalty[s], cell, weights) for s in (slice(0, 500), slice(500, 900)))
    for t in range(40):
        want = 0.3 * np.sqrt(((side[t, :3] - x[:, :3]) ** 2).sum(1)) / 100 + 0.1 * np.abs(side[t, 3] - x[:, 3]) + penalty + 0.6 * (np.sqrt(((grid[t] - g) ** 2).sum(2)) @ cell) / 6400
        want[ids == own[t]] = np.inf
        best = np.lexsort((ids, want))[0]
        assert who[t] == ids[best] and abs(top[t] - want[best]) < 1e-9
    assert scored < 0.5 * 40 * 900


def test_greedy_choice(spark):
    rng = np.random.default_rng(6)
    pool = [rng.uniform(0, 255, 192).tolist() for _ in range(30)]
    pool[4] = pool[3]
    rows, spec = [], {0: {}, 1: {}}
    for run in (0, 1):
        for t in range(0, 140, 2 + run):
            picks = rng.choice(30, 8, replace=False)
            spec[run][t] = [(int(i), float(rng.uniform(0, 300)), pool[i]) for i in picks]
            rows += [(run, t, i, s, g) for i, s, g in spec[run][t]]
    df = spark.createDataFrame([*rows, (0, 1, 5, None, None)], "run_id long, tile long, image_id long, score double, grid array<double>")
    got = selector.greedy_choice(df, window=9, tiles_x=60, penalty=90).collect()
    for run in (0, 1):
        assert sorted((r.tile, r.image_id) for r in got if r.run_id == run) == _spec(spec[run], 9, 60, 90)
    assert selector.auto_window(10, 100) == 300 and selector.greedy_choice(df.limit(0), 5).count() == 0


def test_library_edges(spark):
    empty = spark.createDataFrame([], "id long, avg_l double, avg_a double, avg_b double, use_count int, file_path string")
    assert library.library_stats(empty).first().total == 0
    assert [r.n for r in library.l_histogram(empty).orderBy("bin").collect()] == [0] * 8
    df = spark.createDataFrame([(1, -5.0, 1.0, 1.0), (2, 300.0, 1.0, 1.0), (3, None, None, None)], "id long, avg_l double, avg_a double, avg_b double")
    assert [r.n for r in library.l_histogram(df).orderBy("bin").collect()] == [1, 0, 0, 0, 0, 0, 0, 1]
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert sorted(map(tuple, library.upsert(base, spark.createDataFrame([("b", "3"), ("b", "4"), ("c", "5")], base.schema), "key").collect())) == [("a", "1"), ("b", "4"), ("c", "5")]


def test_output_plans():
    assert output.parse_size("90x160") == (90, 160)
    with pytest.raises(ValueError, match="WxH"):
        output.parse_size("90x160bad")
    with pytest.raises(ValueError, match="writeMode must be auto, stream, or batch"):
        output.streams(10, 10, "png", "invalid")
    assert output.parse_flag("YES", False) and not output.parse_flag("off", True) and output.parse_flag("", True)
    assert output.fitted(70_000, 10, "jpg", False) == (70_000, 10, "tiff") and output.fitted(70_000, 10, "jpg", True)[2] == "jpg"
    assert output.cover_crop(100, 100, 36, 64) == (64, 64, 14, 0)
    assert output.output_format("a/b.TIF") == "tiff" and output.output_format("x.unknown") == "jpg"
    assert pixels.levels(72, 128) == 7


def test_png_and_pyramid(spark, tmp_path):
    from gridloom.plans.rasters import raster
    from gridloom.sinks.raster import level_size, write_png, write_pyramid

    one_image = raster(spark).where("image_id = 0")
    write_png(one_image, str(tmp_path / "a.png"), 72, 128)
    data, at, body = (tmp_path / "a.png").read_bytes(), 8, b""
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(128, 72 * 3 + 1)[:, 1:].reshape(128, 72, 3)
    want = np.zeros((128, 72, 3), int)
    for r in one_image.collect():
        want[r.y, r.x] = (r.r, r.g, r.b)
    assert (rows == want).all()
    made = write_pyramid(one_image, str(tmp_path), "p", 72, 128, 64)
    assert made.where("level = 7").count() == 4 and made.where("level = 0").count() == 1
    assert (tmp_path / "p_files" / "7" / "1_1.png").exists() and 'Width="72"' in (tmp_path / "p.dzi").read_text()
    assert level_size(72, 128, 6) == (36, 64)


def test_image_source(spark, tmp_path):
    from gridloom.sinks.raster import png_stream
    from gridloom.sources.images import content_hashes, image_files, image_pixels, sqlite_table

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PNG").write_bytes(b"".join(png_stream([bytes([1, 2, 3, 4, 5, 6])] * 2, 2, 2)))
    (tmp_path / "in" / "b.txt").write_text("x")
    assert image_files(spark, str(tmp_path / "in")).count() == 1
    p = {(r.y, r.x): (r.r, r.g, r.b) for r in image_pixels(spark, str(tmp_path / "in")).collect()}
    assert p == {(0, 0): (1, 2, 3), (0, 1): (4, 5, 6), (1, 0): (1, 2, 3), (1, 1): (4, 5, 6)}
    h = 0xCBF29CE484222325
    for byte in (tmp_path / "in" / "a.PNG").read_bytes():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    assert content_hashes(image_files(spark, str(tmp_path / "in"))).first().file_hash == str(h)
    import sqlite3

    with sqlite3.connect(tmp_path / "l.db") as db:
        db.execute("CREATE TABLE meta (key TEXT, value TEXT)")
        db.execute("INSERT INTO meta VALUES ('feature_w', '180')")
    assert sqlite_table(spark, str(tmp_path / "l.db"), "meta", "key string, value string").first().value == "180"


def test_streams(spark, tmp_path):
    from gridloom.streaming.append import append_new

    src, lib, state = (str(tmp_path / n) for n in ("src", "lib", "state"))
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "k string, v int").write.parquet(src)
    read = lambda: spark.readStream.schema("k string, v int").parquet(src)
    append_new(spark, read(), lib, "k", state)
    spark.createDataFrame([("b", 5), ("c", 6)], "k string, v int").write.mode("append").parquet(src)
    append_new(spark, read(), lib, "k", state)
    append_new(spark, read(), lib, "k", state)
    assert sorted(r.k for r in spark.read.parquet(lib).collect()) == ["a", "b", "c"]


def test_cut_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert cut(df).schema == df.schema and sorted(cut(df).collect()) == sorted(df.collect())


def test_cuts_can_be_dropped(spark):
    import os

    from gridloom import session

    held = list(session._cuts)
    session._cuts.clear()
    df = cut(spark.range(5).toDF("a"))
    place = session._cuts[0][1]
    assert df.count() == 5 and os.path.isdir(place) and session.drop_cuts() == 1 and not os.path.exists(place) and session.drop_cuts() == 0
    session._cuts.extend(held)


def test_no_machine_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from gridloom import session

    none = SimpleNamespace(get=lambda *a: None)
    for master, fine in (("local[2]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)):
        context = SimpleNamespace(master=master, getConf=lambda: none, getCheckpointDir=lambda: None)
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=context)
        if fine:
            assert session.shared_folder(fake).rpartition("/")[2].startswith("gridloom-")
        else:
            with pytest.raises(RuntimeError):
                session.shared_folder(fake)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_best_of_nearest(spark, monkeypatch):
    """Every tile's best among its nearest rows, over several blocks of the library, without moving candidate pairs."""
    rng = np.random.default_rng(21)
    n, k = 700, 9
    grid = np.rint(rng.uniform(0, 255, (n, 192)))
    grid[300:400] = grid[200:300]  # equal distances
    side = np.round(np.c_[rng.uniform(0, 255, (n, 3)), rng.uniform(0, 1, n)], 2)
    side[300:400] = side[200:300]
    uses = [None if i % 5 == 0 else i % 7 for i in range(n)]
    rows = [(i, *map(float, side[i]), grid[i].tolist(), uses[i]) for i in range(n)]
    rows[650] = (650, *rows[650][1:4], float("nan"), *rows[650][5:])
    lib = spark.createDataFrame(rows, "id long, avg_l double, avg_a double, avg_b double, edge_density double, g array<float>, use_count int")
    tiles = lib.where("id % 3 = 0").withColumn("tile", F.col("id") + 1000)
    monkeypatch.setattr(selector, "LIBRARY_BLOCK", 150)
    found = selector.best_of_nearest(lib, tiles, k, {"lab": 0.2, "grid": 0.45, "edge": 0.05}, 0.01)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r.tile: (r.image_id, r.ann_rank, r.score) for r in found.collect()}
    x, cell = np.c_[side[:, :3] / 255, grid / 255, side[:, 3]], np.array(v.CELL_WEIGHTS)
    for t in range(0, n, 3):
        d = np.sqrt(((x - x[t]) ** 2).sum(1))
        d[[t, 650]] = np.inf
        near = np.lexsort((np.arange(n), d))[:k]
        far = np.sqrt(((grid[near] - grid[t]) ** 2).reshape(k, 64, 3).sum(2)) @ cell / 6400
        score = (0.2 * np.sqrt(((side[near, :3] - side[t, :3]) ** 2).sum(1)) / 100 + 0.45 * far + 0.05 * np.abs(side[near, 3] - side[t, 3])) / 0.7 + np.array([uses[i] or 0 for i in near]) * 0.01
        best = min(range(k), key=lambda i: (round(score[i], 12), near[i]))
        assert got[t + 1000][:2] == (near[best], best + 1) and abs(got[t + 1000][2] - score[best]) < 1e-9
    assert len(got) == len(range(0, n, 3))
    assert selector.best_of_nearest(lib.limit(0), tiles, k, {"lab": 1, "grid": 1, "edge": 1}, 0).count() == 0 and selector.best_of_nearest(lib, tiles.limit(0), k, {"lab": 1, "grid": 1, "edge": 1}, 0).count() == 0
