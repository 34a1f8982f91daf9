"""Training-data operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import datetime as dt
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import clusters, history, imaging, mixing, neardup, neighbours, packing, subset, survivors, tokens, visual

IMAGES = "id long, file_hash string, avg_l double, avg_a double, avg_b double, saturation double, edge_density double, grid4x4 array<float>, mean_brightness double, use_count int, feature_version int, created_at timestamp_ntz, rank int, node string"


def image(i, grid, h=None, **over):
    row = {"id": i, "file_hash": str(i + 10**6) if h is None else h, "avg_l": 100.0, "avg_a": 128.0, "avg_b": 128.0, "saturation": 50.0, "edge_density": 0.2, "grid4x4": None if grid is None else [float(x) for x in grid], "mean_brightness": 90.0, "use_count": 1, "feature_version": 5, "created_at": dt.datetime(2024, 1, 1), "rank": 0, "node": "x"} | over
    return tuple(row[c.split()[0]] for c in IMAGES.split(", "))


@pytest.fixture(scope="module")
def library(spark):
    """Scenes, processed and mirrored copies, copies by hash, void hashes, invalid rows."""
    rng = np.random.default_rng(9)
    rows, i = [], 0
    for scene, size in enumerate((40, 25, 21, 12)):
        base = rng.uniform(40, 200, 192)
        for k in range(size):
            i += 1
            rows.append(image(i, np.clip(np.round((base + rng.normal(0, 6, 192)) * 4) / 4, 0, 255), avg_l=100.0 + scene, saturation=50.0 + (k % 2) * 25))
    for _ in range(60):
        i += 1
        g = np.round(rng.uniform(0, 255, 192) * 4) / 4
        rows.append(image(i, g, avg_l=float(rng.uniform(60, 200))))
        if i % 3 == 0:
            near = np.clip(g + rng.normal(0, 1, 192), 0, 255)
            near[:9] = 0
            if i % 2:
                near = near.reshape(8, 8, 3)[:, ::-1].ravel()
            i += 1
            rows.append(image(i, near, avg_l=rows[-1][2] + 2))
    twin = rng.uniform(0, 255, 192)
    for k in range(4):
        i += 1
        rows.append(image(i, twin, h=" " if k % 2 else "-"))
    for k in range(5):
        i += 1
        rows.append(image(i, rng.uniform(0, 255, 192), h=["77", "0x4d", " 077", "77", "0x4D"][k]))
    bad = rng.uniform(0, 255, 192)
    wrong = [bad[:48], np.r_[bad[:191], 300], np.r_[bad[:191], np.nan], None]
    for g in wrong:
        i += 1
        rows.append(image(i, g))
    rows.append(image(i + 1, bad, avg_a=None))
    rows.append(image(i + 2, None, file_hash=None, use_count=None, feature_version=None, created_at=None, mean_brightness=None))
    return spark.createDataFrame(rows, IMAGES).repartition(3).cache(), rows


@pytest.fixture(scope="module")
def comparable(library):
    return imaging.comparable_images(library[0]).cache()


def _local(comparable):
    p = comparable.toPandas().sort_values("id").reset_index(drop=True)
    return p, imaging.unpack(pa.array(list(p.vec), pa.binary())).astype(float)


def test_comparable(comparable, library, spark):
    p, g = _local(comparable)
    rows = [r for r in library[1] if r[7] is not None and len(r[7]) == 192 and all(0 <= x <= 255 for x in r[7]) and r[3] is not None]
    by_hash = {}
    for r in rows:
        key = 77 if r[1].strip().lower() in ("77", "077", "0x4d") else r[0] if r[1] in (" ", "-") else int(r[1])
        by_hash.setdefault((key, r[1] in (" ", "-")), r[0])
    assert sorted(p.id) == sorted(by_hash.values())
    want = {r[0]: np.array(r[7], np.float32) for r in rows}
    assert all((g[k] == want[i]).all() for k, i in enumerate(p.id))
    assert imaging.comparable_images(library[0].limit(0)).count() == 0


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    v = (rng.integers(0, 1021, (40, 192)) / 4).astype(np.float32)
    v[3], v[39, 0] = rng.uniform(0, 255, 192), np.float32(0.1)
    assert (imaging.unpack(imaging.pack(v)) == v).all() and (imaging.unpack(imaging.pack(v).slice(2, 5)) == v[2:7]).all()
    assert len(imaging.unpack(imaging.pack(v[:0]))) == 0


def test_clusters(comparable, spark):
    p, g = _local(comparable)
    linked = (np.sqrt(((g[:, None] - g[None]) ** 2).mean(2)) <= 20) & (np.abs(p.avg_l.values[:, None] - p.avg_l.values) <= 20) & (np.abs(p.saturation.values[:, None] - p.saturation.values) <= 30)
    root = np.arange(len(p))
    while True:
        new = np.array([root[linked[k]].min() for k in range(len(p))])
        if (new == root).all():
            break
        root = new
    want = {(p.id[root[k]], p.id[k]) for k in range(len(p)) if (root == root[k]).sum() >= 20}
    got = clusters.linked_clusters(comparable).cache()
    assert {(r.cluster_key, r.image_id) for r in got.collect()} == want and len({a for a, _ in want}) == 3
    report = {r.cluster_key: r for r in clusters.cluster_report(got, comparable).collect()}
    assert sorted(r.members for r in report.values()) == [21, 25, 40] and all(len(r.typical) == 3 for r in report.values())
    for key, r in report.items():
        ids = sorted(i for k, i in want if k == key)
        at = [int(np.flatnonzero(p.id.values == i)[0]) for i in ids]
        d = np.sqrt(((g[at] - g[at].mean(0)) ** 2).mean(1))
        assert r.typical == [ids[k] for k in np.lexsort((ids, np.round(d, 6)))[:3]]
    assert sum(r.images for r in clusters.leaf_report(comparable).collect()) >= 60
    assert clusters.linked_clusters(comparable.limit(0)).count() == 0 and clusters.leaf_report(comparable.limit(0)).count() == 0


def test_cluster_tree_splits_large_groups(spark, monkeypatch, comparable):
    monkeypatch.setattr(clusters, "GROUP", 40)
    monkeypatch.setattr(clusters, "SAMPLE", 5)  # no compact leaf at first: all rows are loose, in one group
    got = clusters.linked_clusters(comparable)
    assert sorted(r["count"] for r in got.groupBy("cluster_key").count().collect()) == [21, 25, 40]


def test_dense_groups_end(spark, monkeypatch):
    """A ball of equal-looking rows and a hollow one, both larger than a task's group and absent from the first sample."""
    rng = np.random.default_rng(3)
    away = rng.normal(size=(9000, 192))
    away *= np.r_[rng.uniform(0, 9, 5000), np.full(4000, 12.0)][:, None] * 192**0.5 / np.sqrt((away**2).sum(1))[:, None]
    grids = np.clip(np.rint((np.where(np.arange(9000) < 5000, 90, 160)[:, None] + away) * 4) / 4, 0, 255).astype(np.float32)
    rows = spark.createDataFrame([(i, 100.0, 50.0, bytes(v)) for i, v in enumerate(imaging.pack(grids).to_pylist())], "id bigint, avg_l double, saturation double, vec binary").repartition(4)
    monkeypatch.setattr(clusters, "GROUP", 700)
    monkeypatch.setattr(clusters, "GROUP_SAMPLE", 300)
    monkeypatch.setattr(clusters, "SAMPLE", 2)
    loose = clusters._placed(rows).where("grp IS NOT NULL").select("id", "grp", "vec", "avg_l", "saturation")
    split, _ = clusters._split_on(loose)
    assert split.count() <= 3 * 9000 and split.groupBy("grp").count().agg(F.max("count")).first()[0] <= 700
    got = sorted((r["cluster_key"], r["count"]) for r in clusters.linked_clusters(rows).groupBy("cluster_key").count().collect())
    assert got == [(0, 5000), (5000, 4000)]


def test_links_across_splits(spark):
    # A chain whose links are all longer than a split's margin.
    grids = np.repeat(np.arange(24, dtype=np.float32)[:, None] * 11, 192, axis=1)
    made = [(i, 100.0, 50.0, v) for i, v in enumerate(imaging.pack(grids).to_pylist())]
    rows = spark.createDataFrame([*made, (99, 100.0, float("nan"), made[3][3])], "id long, avg_l double, saturation double, vec binary")
    got = clusters.linked_clusters(rows).collect()
    assert sorted(map(tuple, got)) == [(0, i) for i in range(24)]
    parted = [(i, 0 if i < 9 else 9, *v[1:]) for i, v in enumerate(made)]
    keyed = spark.createDataFrame([r[:2] for r in parted], "id long, key long")
    assert {tuple(sorted(r)) for r in clusters.missed_links(rows.where("id < 24"), keyed).collect()} == {(0, 9)}


def test_missed_links_write_few_pairs(spark, monkeypatch):
    # Two dense clusters whose balls are in reach of each other, though only one pair of their rows is linked.
    rng = np.random.default_rng(4)
    grids = np.r_[100 + rng.normal(0, 8, (200, 192)), 126 + rng.normal(0, 8, (200, 192)), [np.full(192, 108.0)], [np.full(192, 118.0)]].astype(np.float32)
    keys = np.r_[np.zeros(200, int), np.ones(200, int), 0, 1]
    d = np.sqrt(((grids[:, None].astype(float) - grids[None]) ** 2).mean(2))
    assert ((d <= 20) & (keys[:, None] < keys[None])).any() and ((d <= 20) & (keys[:, None] < keys[None])).sum() < 500
    rows = spark.createDataFrame([(i, 100.0, 50.0, v) for i, v in enumerate(imaging.pack(grids).to_pylist())], "id long, avg_l double, saturation double, vec binary")
    written = []
    cut = clusters.cut
    monkeypatch.setattr(clusters, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = clusters.missed_links(rows, spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], "id long, key long"))
    assert {tuple(sorted(r)) for r in got.collect()} == {(0, 1)}
    assert max(t.count() for t in written) < 10_000


def test_near_duplicates(comparable):
    p, g = _local(comparable)
    want = set()
    for a in range(len(p)):
        for b in range(a + 1, len(p)):
            if max(abs(p[c][a] - p[c][b]) for c in ("avg_l", "avg_a", "avg_b")) <= 8 and neardup.agreeing_cells(g[a : a + 1], g[b : b + 1])[0] >= 58:
                want.add((p.id[a], p.id[b]))
    rows = [tuple(r) for r in neardup.near_duplicates(comparable).collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= want and len(want - set(rows)) <= 0.05 * len(want) and len(want) >= 20
    assert neardup.near_duplicates(comparable.limit(0)).count() == 0


def test_near_duplicate_tokens_ignore_mirroring():
    g = np.random.default_rng(0).uniform(0, 255, (5, 192)).astype(np.float32)
    m = np.ascontiguousarray(g.reshape(5, 8, 8, 3)[:, :, ::-1]).reshape(5, 192)
    assert (np.sort(neardup.tokens(g), 1) == np.sort(neardup.tokens(m), 1)).all()
    assert neardup.least_matches(32, 1) > neardup.least_matches(8, 1)


def test_neighbours(comparable, spark):
    p, g = _local(comparable)
    x = np.c_[p.avg_l / 255, g / 255, p.edge]
    asked = spark.createDataFrame([(n, int(i)) for n, i in enumerate(p.id)] + [(10_000, None), (10_001, -5), (0, int(p.id[0]))], "q long, own long")
    got = {}
    for r in neighbours.nearest_images(comparable, asked, 5).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id))
    assert set(got) == set(range(len(p)))
    hits = 0
    for n in range(len(p)):
        d = np.sqrt(((x - x[n]) ** 2).sum(1))
        d[n] = np.inf
        hits += len({i for _, i in got[n]} & set(p.id.values[np.lexsort((p.id.values, d))[:5]]))
        assert len(got[n]) == 5
    assert hits >= 0.9 * 5 * len(p)
    assert neighbours.nearest_images(comparable.limit(0), asked, 5).count() == 0


def test_neighbours_are_exact_where_codes_are_dense(spark):
    """Unrelated rows fill the radius of most queries, while a nearest row's code lies beyond it."""
    rng = np.random.default_rng(8)
    grids = np.clip(128 + rng.normal(0, 30, (3000, 7)) @ rng.normal(0, 1, (7, 192)) + rng.normal(0, 2, (3000, 192)), 0, 255)
    packed = imaging.pack(np.rint(grids).astype(np.float32)).to_pylist()
    rows = spark.createDataFrame([(i, 100.0, 0.5, bytes(v)) for i, v in enumerate(packed)], "id bigint, avg_l double, edge double, vec binary")
    asked = rows.where("id % 15 = 0").select(F.col("id").alias("q"), F.col("id").alias("own"))
    x = np.rint(grids) / 255
    got: dict[int, list] = {}
    for r in neighbours.nearest_images(rows, asked, 5).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    for q in range(0, 3000, 15):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert got[q] == np.lexsort((np.arange(3000), d))[:5].tolist()


def test_neighbours_move_no_rows(comparable, spark):
    """A radius' candidates are ranked where the rows lie: nothing but each task's best is shuffled."""
    rows = comparable.select("id", "avg_l", "edge", "vec")
    queries = rows.where("id % 3 = 0").select(F.col("id").alias("q"), F.col("id").alias("own"), "avg_l", "edge", "vec").toArrow()
    mean, w = neighbours.learn_codes(neighbours.feature_rows(rows.toArrow()))
    code = lambda t: neighbours._encode(neighbours.feature_rows(t), mean, w)
    table = rows.toArrow()
    codes = spark.createDataFrame(list(zip(table.column("id").to_pylist(), code(table).tolist())), "id long, code long")
    for widths, radius in (([16] * 4, 11), ([32, 32], 5), ([12, 12, 12, 12, 16], 14), ([16] * 4, 3)):
        found = neighbours.probe_block(rows, queries, radius, widths, mean, w, 10_000)
        want = neighbours.within_radius(codes, codes.where("id % 3 = 0").select(F.col("id").alias("q"), F.col("id").alias("own"), "code"), radius, widths)
        assert sorted(map(tuple, found.select("q", "id").collect())) == sorted(map(tuple, want.collect()))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_hamming_radius_is_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 20)
    codes = [(i, int(np.int64(base[i % 20]) ^ np.int64(sum(1 << int(b) for b in rng.choice(63, i % 14, replace=False))))) for i in range(300)]
    df = spark.createDataFrame(codes, "id long, code long")
    got = sorted(map(tuple, neighbours.within_radius(df, df.where("id < 40").select(F.col("id").alias("q"), F.col("id").alias("own"), "code"), 11).collect()))
    want = sorted((a, b) for a, x in codes[:40] for b, y in codes if a != b and bin((x ^ y) & (2**64 - 1)).count("1") <= 11)
    assert got == want


def test_survivors(spark):
    rows = [(1, "g", "A", 5, dt.datetime(2024, 1, 1)), (2, "g", "a", 1, dt.datetime(2025, 12, 1)), (3, "g", "b", 1, dt.datetime(2025, 12, 1)), (4, "g", None, 5, None), (5, None, "z", 5, None), (6, "lone", "q", 1, None), (7, "h", None, 1, None), (8, "h", None, 1, None)]
    df = spark.createDataFrame(rows, "id long, grp string, name string, trust int, at timestamp_ntz").withColumn("votes", F.lit(1)).withColumn("field", F.lit("x"))
    decay = survivors.recency_decay(F.col("at"), "2026-01-01", 365, 0.01)
    got = {r.g: r for r in survivors.surviving_records(df, F.col("grp"), {"keep": F.col("id"), "name": F.lower("name")}, F.col("trust"), decay, F.struct("at", (-F.col("id")).alias("i"))).collect()}
    assert set(got) == {"g", "h"} and got["g"].records == 4 and got["g"]["name"] == "a" and got["g"].keep == "1"
    assert got["h"]["name"] is None and got["h"].keep == "7"
    assert survivors.surviving_records(df.limit(0), F.col("grp"), {"keep": F.col("id")}, F.col("trust"), decay, F.struct("id")).count() == 0


def test_votes_beyond_64_bits(spark):
    df = spark.createDataFrame([(i, "g", "a" if i < 3 else "b") for i in range(4)], "id long, grp string, name string")
    got = survivors.surviving_records(df, F.col("grp"), {"keep": F.col("id"), "name": F.col("name")}, F.lit(9e9), F.lit(1.0), F.struct((-F.col("id")).alias("i"))).collect()
    assert [(r.g, r.records, r.keep, r["name"]) for r in got] == [("g", 4, "0", "a")]


def test_history(spark, tmp_path):
    path = lambda n: [("place", 2**40 + 7, x) for x in n]
    old = spark.createDataFrame([*path(["a/b", "a/b", "c"]), ("hash", -5, "-5"), ("hash", None, None)], "kind string, fp long, text string")
    new = [(1, 1, "place", 2**40 + 7, "a/b"), (2, 1, "place", 2**40 + 6, "new"), (3, 2, "place", 2**40 + 6, "new"), (4, None, "hash", -5, "-5"), (5, 3, "hash", None, None), (6, 3, "hash", -4, "-4"), (7, 3, "hash", -4, "-4"), (8, None, "place", 2**40 + 6, "new")]
    df = spark.createDataFrame(new, "incoming_id long, batch_no long, kind string, fp long, text string")
    df = df.withColumn("pos", F.struct(F.col("batch_no").isNull().alias("n"), "batch_no", "incoming_id"))
    store = history.BlockStore(spark, str(tmp_path / "store"), 1)
    store.append(old, -1)
    want = {1: -1, 3: 0, 4: -1, 7: 2, 8: 0}
    assert {r.incoming_id: r.first_batch for r in history.deduplicate_batches(store, df).collect()} == want
    held = sorted(map(tuple, spark.read.parquet(store.path).collect()))
    assert {r.incoming_id: r.first_batch for r in history.deduplicate_batches(store, df).collect()} == want  # all over again
    assert sorted(map(tuple, spark.read.parquet(store.path).collect())) == held
    assert history.deduplicate_batches(store, df.limit(0)).count() == 0


def test_large_batches_leave_the_store_where_it_lies(spark, tmp_path, monkeypatch):
    entries = lambda numbers: spark.createDataFrame([("place", n * 7919 << 20 | n, f"folder/{n}") for n in numbers], "kind string, fp long, text string")
    store = history.BlockStore(spark, str(tmp_path / "store"), 1, parts=8)
    store.append(entries(range(300)), -1)
    store.append(entries(range(250, 400)), 0)
    monkeypatch.setattr(history, "SMALL_BATCH", 20_000)
    plans, cut = [], history.cut
    monkeypatch.setattr(history, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.lookup(entries(range(200, 500)), 1)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert {r.text: r.first_batch for r in found.collect()} == {f"folder/{n}": -1 if n < 300 else 0 for n in range(200, 400)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 3 and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)


def test_lookup_reads_only_the_folders_it_needs(spark, tmp_path):
    rng = np.random.default_rng(7)
    codes = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 500)]
    store = history.BlockStore(spark, str(tmp_path / "store"), 1, parts=16)
    store.append(spark.createDataFrame([("hash", c, str(c)) for c in codes], "kind string, fp long, text string"), -1)
    asked = spark.createDataFrame([("hash", codes[3], str(codes[3])), ("hash", codes[4] ^ 1, str(codes[4])), ("hash", codes[5] ^ 3, str(codes[5])), ("hash", codes[6] ^ 1, "other")], "kind string, fp long, text string")
    assert sorted(r.text for r in store.lookup(asked, 0).collect()) == sorted([str(codes[3]), str(codes[4])])
    near = {r.text for r in store.lookup(asked, 0, F.lit(True)).collect()}
    assert near == {str(codes[3]), str(codes[4]), "other"}
    parts = [r.part for r in store._tables(asked.limit(1)).select("part").distinct().collect()]
    files = store._stored(0, parts).select(F.input_file_name().alias("f")).distinct().collect()
    assert 1 <= len(files) <= 2 and all(any(f"part={p}/" in r.f for p in parts) for r in files)


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("witnesses", [(), (2, 32)])
def test_near_rows_equal_brute_force(spark, monkeypatch, witnesses):
    monkeypatch.setattr(history, "WITNESSES", witnesses)
    monkeypatch.setattr(history, "BLOCK", 20)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdeé/12ü") for _ in range(n))
    def edited(t: str) -> str:
        for _ in range(rng.randrange(1, len(t) // 4 + 2)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "z", "zz"]) + t[k + 1 :] or "q"
        return t
    old = [text(rng.randrange(3, 40)) for _ in range(40)]
    new = [edited(rng.choice(old)) for _ in range(60)] + [text(rng.randrange(3, 40)) for _ in range(20)]
    new += [edited(rng.choice(new)) for _ in range(40)] + new[:3] + new[70:74]
    near = lambda a, b: 1 - _edits(a, b) / max(len(a), len(b), 1) >= 0.8
    want = {}
    for i, t in enumerate(new):
        in_history = any(near(t, o) for o in old)
        if in_history or any(near(t, o) for o in new[:i]):
            want[i] = in_history
    entries = lambda rows: history.with_fingerprint(spark.createDataFrame(rows, "incoming_id long, pos long, kind string, text string"), "text")
    got = history.near_rows(entries([(None, None, "place", t) for t in [*old, None]]), entries([(i, i, "place", t) for i, t in enumerate([*new, None])]), 3, 0.8)
    assert sorted((r.incoming_id, r.in_history) for r in got.collect()) == sorted(want.items()) and len(set(want.values())) == 2


def test_block_tables_find_all_within_bits(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30)]
    for bits in (0, 1, 3):
        pairs = [(x, int(np.int64(x) ^ np.int64(sum(1 << int(b) for b in rng.choice(63, bits, replace=False))))) for x in base]
        a = history.block_tables(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pairs)], "i int, fp long"), bits)
        b = history.block_tables(spark.createDataFrame([(i, y) for i, (_, y) in enumerate(pairs)], "i int, fp long"), bits)
        assert a.join(b, ["i", "table_no", "lead"]).select("i").distinct().count() == 30


def test_fingerprints():
    got = history.fingerprints_of(pa.array(["some/long/path/to/a/file.jpg", "some/long/path/to/a/file.png", "another thing entirely", None, "", "ab"]))
    far = lambda a, b: bin((int(a) ^ int(b)) & (2**64 - 1)).count("1")
    assert far(got[0], got[1]) < far(got[0], got[2]) and len(history.fingerprints_of(pa.array([], pa.string()))) == 0


def test_subset(library):
    df, rows = library
    for k in (1, 17, 60, 10_000):
        got = subset.varied_subset(df, k).collect()
        assert len(got) == min(k, len(rows)) == len({r.id for r in got})
        per = {}
        for r in got:
            per.setdefault(r.cell, []).append(r["rank"])
        assert all(sorted(x) == list(range(1, len(x) + 1)) for x in per.values())
        if k < len(rows):
            most = max(len(x) for x in per.values())
            whole = {c: n for c, n in ((r.cell, r.n) for r in subset.varied_subset(df, 10_000).groupBy("cell").agg(F.count("*").alias("n")).collect())}
            assert all(len(per.get(c, [])) >= min(n, most - 1) for c, n in whole.items())
    report = subset.coverage(df, subset.varied_subset(df, 17)).first()
    assert report.cells == len(whole) and report.covered == 17 and report.chosen == 17 and report.images == len(rows)
    used = subset.varied_subset(df.withColumn("use_count", F.lit(2000) + F.col("id").cast("int")).withColumn("grid4x4", F.lit(None).cast("array<float>")).withColumn("file_hash", F.lit(None).cast("string")).withColumn("mean_brightness", F.lit(1.0)), 10)
    assert sorted(r.id for r in used.collect()) == sorted(r[0] for r in rows)[:10]  # the less used first, however much all are used
    assert subset.varied_subset(df, 0).count() == 0 and subset.varied_subset(df.limit(0), 5).count() == 0


def test_best_fit():
    rng = np.random.default_rng(2)
    for score in ("residual", "dot"):
        t = rng.integers(0, 500, 700).astype(float)
        sizes = np.c_[t, np.ones(700), t**2]
        caps = np.array([512.0, 20, 200_000.0])
        sizes = np.minimum(sizes, caps)
        bins = packing.best_fit(sizes, caps, np.array([1.0, 0.1, 0.1]), score)
        for d in range(3):
            assert np.bincount(bins, weights=sizes[:, d]).max() <= caps[d] + 1e-6
        assert bins.max() + 1 <= 1.15 * max((sizes / caps).sum(0))
    assert len(packing.best_fit(np.zeros((0, 3)), np.ones(3), np.ones(3))) == 0


def test_packs(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([None, 0, 3, 80, 300, 512, 513, 5000, rng.randrange(1, 900)])) for i in range(300)] + [(7, 44), (None, 10)]
    sized = spark.createDataFrame(docs, "doc_id long, n_tokens long").repartition(3).cache()
    caps = spark.createDataFrame([("small", 512), ("large", 4096), ("none", 0), ("nil", None)], "pack_name string, capacity int")
    got = packing.packs(sized, caps, shard=64).collect()
    for name, cap in (("small", 512), ("large", 4096)):
        mine = [r for r in got if r.pack_name == name]
        assert sum(r.n_tokens for r in mine) == sum(n or 0 for _, n in docs)
        load, count = {}, {}
        for r in mine:
            load[r.pack_id] = load.get(r.pack_id, 0) + r.n_tokens
            count[r.pack_id] = count.get(r.pack_id, 0) + 1
        assert max(load.values()) <= cap and max(count.values()) <= 64
        whole = {i: n for i, n in docs[:300] if i != 7}
        for i, n in whole.items():
            pieces = sorted((r.piece_no, r.piece_start, r.n_tokens) for r in mine if r.doc_id == i)
            assert len(pieces) == max(1, -(-(n or 0) // cap)) and sum(p[2] for p in pieces) == (n or 0)
            assert all(s == k * cap for k, (_, s, _) in enumerate(pieces))
    assert {r.pack_name for r in got} == {"small", "large"}
    report = packing.pack_report(packing.packs(sized, caps, shard=64), caps).collect()
    assert all(0.8 < r.fill <= 1 for r in report)
    assert packing.packs(sized.limit(0), caps).count() == 0 and packing.packs(sized, caps.limit(0)).count() == 0


def test_attention_cost_decides(spark):
    sized = spark.createDataFrame([(1, 95), (2, 5), (3, 60), (4, 40)], "doc_id long, n_tokens long")
    caps = spark.createDataFrame([("a", 100)], "pack_name string, capacity int")
    together = lambda share: sorted(sorted(r.ids) for r in packing.packs(sized, caps, cost_share=share).groupBy("pack_id").agg(F.collect_list("doc_id").alias("ids")).collect())
    assert together(1.0) == [[1, 2], [3, 4]] and together(0.8) == [[1], [2], [3, 4]] and together(0.5) == [[1], [2, 3], [4]]


def test_packs_do_not_depend_on_layout(spark):
    rng = random.Random(6)
    docs = [(rng.randrange(200), rng.choice([10, 70, 300])) for _ in range(500)] + [(7, 44)] * 300
    sized = spark.createDataFrame(docs, "doc_id long, n_tokens long")
    caps = spark.createDataFrame([("a", 512)], "pack_name string, capacity int")
    one, two = (sorted(map(tuple, packing.packs(x, caps, shard=100).collect())) for x in (sized, sized.orderBy(F.rand(1)).repartition(5)))
    assert one == two and len(one) == 800


def test_mixture(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a"] * 6 + ["b", "b", "c", "x", None]), rng.choice([0, None, 5, 50, 500])) for i in range(3000)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").cache()
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("empty", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(sized, targets).cache()
    by = {r.source: r for r in mixing.mixture_shares(mixed, sized, targets).collect()}
    for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3)):
        assert abs(by[s].actual_share - share / 0.9) < 0.02 and by[s].most_copies <= cap
    assert by["empty"].docs == 0 and by["empty"].actual_share == 0
    assert {r.source for r in mixed.collect()} == {"a", "b", "c"} and mixed.count() == mixed.select("doc_id").distinct().count()
    again = mixing.mixture(sized.repartition(5), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    small = mixing.mixture(sized, targets, total=5000).agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert abs(small - 5000) < 800
    assert mixing.mixture(sized.limit(0), targets).count() == 0


def test_tokens(spark):
    long = "word " * 30_000
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, long), (5, "<|endoftext|>")], "doc_id long, text string").withColumn("n_tokens", F.lit(-1))
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_count(df, "text").collect()}
    encode = tokens.encoder(tokens.TOKENIZER).encode_ordinary
    assert got == {1: len(encode("Hello world")), 2: 0, 3: 0, 4: len(encode(long)), 5: len(encode("<|endoftext|>"))}


def test_canonical_equals_composition():
    rng = random.Random(1)
    alpha = "aeiouEAcnxyz 2" + "゙゚̧̣̈̀́̂̊" + "éçñüがぱｅ" + "각가"
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randrange(25))) for _ in range(4000)]
    got = visual.canonical_array(pa.array(texts)).to_pylist()
    assert got == [unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).replace("ｅ", "e")) for t in texts]
    assert visual.canonical_array(pa.array(got)).to_pylist() == got


def test_canonical_rules():
    same = [("ﬁﬂ ﬃ", "fifl ffi"), ("ＡＢ　ｃ１", "AB c1"), ("a­b​c﻿⁠", "abc"), ("x y z ", "x y z "), ("K Å Ω µ", "K Å Ω μ"), ("ѕtор", "stop"), ("ӀӏօՕɡᎠᏟᏴ", "IloOgDCB"), ("e​́", "é"), ("\uff76\uff9e", "\u30ac"), ("A‑B‐", "A-B-"), ("", ""), (None, None), ("́", "́"), ("\x00\x07a", "a")]
    assert visual.canonical_array(pa.array([a for a, _ in same])).to_pylist() == [b for _, b in same]
    assert visual.canonical_array(pa.array([a for a, _ in same]).slice(2, 3)).to_pylist() == [b for _, b in same[2:5]]
    apart = ["Abc", "abc", "ábc", "a²", "a2", "b a", "a b", "a\nb", "a−b", "a-b"]
    assert len(set(visual.canonical_array(pa.array(apart)).to_pylist())) == len(apart)
    assert visual.canonical_array(pa.array([], pa.string())).to_pylist() == []


def test_canonical_in_small_and_large_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé́е ﬁ​") for _ in range(rng.randrange(60))) for _ in range(300)] + ["é" * 50_000]
    want = visual.canonical_array(pa.array(texts)).to_pylist()
    monkeypatch.setattr(visual, "MAX_BYTES", 100)
    assert visual.canonical_array(pa.array(texts)).to_pylist() == want
    assert want[-1] == "é" * 50_000


def test_equal_looking_pairs(spark):
    rows = [(1, "stop it", "a"), (2, "ѕtop it", "b"), (3, "stop it", "c"), (4, "Stop it", "d"), (5, "stop it", "e"), (6, None, "f"), (7, "", "g"), (8, "​", "h"), (9, "stop  it", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, canonical string").withColumn("form", F.lit(1)).withColumn("k", F.lit(2))
    got = {tuple(r) for r in visual.equal_looking_pairs(df, "doc_id", "text").collect()}
    assert got == {(1, 2), (2, 3), (1, 5), (2, 5), (3, 5), (7, 8)}
    assert visual.equal_looking_pairs(df.limit(0), "doc_id", "text").count() == 0
