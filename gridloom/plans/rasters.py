"""Queries over pixel tables (an arithmetic raster), tile plans and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import pictures
from gridloom.operators import pixels as px
from gridloom.plans.tables import rounded
from gridloom.session import shared_folder, table
from gridloom.streaming.append import append_new, running_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Base colours (B, G, R) of the raster's ten pictures, 72 x 128 pixels each.
COLOURS = [(20, 20, 20), (230, 230, 230), (40, 40, 220), (40, 190, 40), (220, 70, 40), (30, 210, 210), (210, 40, 210), (210, 160, 30), (120, 60, 200), (80, 180, 150)]
WIDTH, HEIGHT = 72, 128


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def raster(spark: SparkSession) -> DataFrame:
    n = WIDTH * HEIGHT
    p = spark.range(len(COLOURS) * n).select(F.floor(F.col("id") / n).cast("int").alias("image_id"), F.floor((F.col("id") % n) / WIDTH).cast("int").alias("y"), (F.col("id") % WIDTH).cast("int").alias("x"))
    base = [F.array(*[F.lit(c[k]) for c in COLOURS])[F.col("image_id")] for k in range(3)]
    stripe = F.when((F.col("x") + F.col("y") + F.col("image_id")) % 19 < 7, 36).otherwise(0)
    i, x, y = F.col("image_id"), F.col("x"), F.col("y")
    return p.select("image_id", "y", "x", ((base[0] + 2 * x + 11 * i + stripe) % 256).alias("b"), ((base[1] + 2 * y + 17 * i) % 256).alias("g"), ((base[2] + x + y + 23 * i) % 256).alias("r"))


_B, _G, _R = (str([c[k] for c in COLOURS]) for k in range(3))
_PIX = f"""idx AS (SELECT i AS image_id, y, x FROM range(10) a(i), range({HEIGHT}) b(y), range({WIDTH}) c(x)),
pix AS (SELECT image_id, y, x, ({_B}[image_id + 1] + 2 * x + 11 * image_id + CASE WHEN (x + y + image_id) % 19 < 7 THEN 36 ELSE 0 END) % 256 AS b, ({_G}[image_id + 1] + 2 * y + 17 * image_id) % 256 AS g, ({_R}[image_id + 1] + x + y + 23 * image_id) % 256 AS r FROM idx),
lin AS (SELECT *, {', '.join(f'CASE WHEN {c} / 255.0::double > 0.04045 THEN pow(({c} / 255.0::double + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::double / 12.92 END * 100 AS l{c}' for c in 'rgb')} FROM pix),
xyz AS (SELECT *, {', '.join(f'(lr * {m[0]} + lg * {m[1]} + lb * {m[2]}) / {w} AS v{n}' for n, m, w in zip('xyz', px.RGB_XYZ, px.WHITE))} FROM lin),
f AS (SELECT *, {', '.join(f'CASE WHEN v{n} > 0.008856 THEN pow(v{n}, 1.0::double / 3) ELSE 7.787::double * v{n} + 16.0::double / 116 END AS f{n}' for n in 'xyz')} FROM xyz),
p AS MATERIALIZED (SELECT CAST(image_id AS INT) AS image_id, y, x, b, g, r, (116 * fy - 16) * 2.55::double AS ll, 500 * (fx - fy) + 128 AS la, 200 * (fy - fz) + 128 AS lb2, 0.299::double * r + 0.587::double * g + 0.114::double * b AS v FROM f)"""


@query(
    f"""WITH {_PIX} SELECT image_id, CAST(max(x) + 1 AS INT) AS width, CAST(max(y) + 1 AS INT) AS height, round(avg(ll), 4) AS avg_l, round(avg(la), 4) AS avg_a, round(avg(lb2), 4) AS avg_b, round(avg(v), 4) AS mean_brightness,
  round(stddev_pop(v), 4) AS std_brightness, round(stddev_pop(v) / 255, 4) AS contrast, round(avg(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::double * 255 ELSE 0 END), 4) AS saturation,
  round(var_pop(la) + var_pop(lb2), 4) AS color_variance FROM p GROUP BY image_id"""
)
def raster_features(spark, d):
    return rounded(px.image_features(raster(spark)), 4)


@query(SQL["raster_features"])
def raster_one_pass(spark, d):
    """The same by one look at each whole picture, without pixel tables being shuffled again for every feature."""
    names = ["image_id", "width", "height", "avg_l", "avg_a", "avg_b", "mean_brightness", "std_brightness", "contrast", "saturation", "color_variance"]
    return rounded(pictures.features_of_pixels(raster(spark)).select(*names), 4)


@query(f"WITH {_PIX} SELECT image_id, CAST((y // {HEIGHT // 8}) * 8 + x // {WIDTH // 8} AS INT) AS cell, round(avg(ll), 4) AS l, round(avg(la), 4) AS a, round(avg(lb2), 4) AS b FROM p GROUP BY ALL")
def raster_grid8(spark, d):
    return rounded(px.grid_cells(raster(spark)), 4)


@query(f"WITH {_PIX} SELECT image_id, CAST((y // {HEIGHT // 4}) * 4 + x // {WIDTH // 4} AS INT) AS cell, round(avg(ll), 4) AS l, round(avg(la), 4) AS a, round(avg(lb2), 4) AS b FROM p GROUP BY ALL")
def raster_grid4(spark, d):
    return rounded(px.grid_cells(raster(spark), 4), 4)


@query(f"WITH {_PIX} SELECT image_id, CAST((y * 16 // {HEIGHT}) * 16 + x * 16 // {WIDTH} AS INT) AS cell, round(avg(v), 6) AS grey FROM p GROUP BY ALL")
def raster_tiny(spark, d):
    return rounded(px.tiny_images(raster(spark)))


@query(
    f"""WITH {_PIX}, n AS (SELECT c.image_id, c.y, c.x, sum(CASE WHEN round(q.v, 9) >= round(c.v, 9) THEN s.bit ELSE 0 END) AS code FROM p c
  JOIN (VALUES (-1,-1,1), (-1,0,2), (-1,1,4), (0,1,8), (1,1,16), (1,0,32), (1,-1,64), (0,-1,128)) s(dy, dx, bit) ON true JOIN p q ON q.image_id = c.image_id AND q.y = c.y + s.dy AND q.x = c.x + s.dx
  WHERE c.y BETWEEN 1 AND {HEIGHT - 2} AND c.x BETWEEN 1 AND {WIDTH - 2} GROUP BY ALL)
SELECT image_id, CAST(code AS INT) AS code, count(*) AS n, round(count(*) / {(WIDTH - 2) * (HEIGHT - 2)}.0::double, 6) AS share FROM n GROUP BY ALL"""
)
def raster_patterns(spark, d):
    return rounded(px.pattern_counts(raster(spark)))


@query(
    f"""WITH {_PIX}, s AS (SELECT image_id, abs(v - lag(v) OVER (PARTITION BY image_id, y ORDER BY x)) + abs(v - lag(v) OVER (PARTITION BY image_id, x ORDER BY y)) AS s FROM p)
SELECT image_id, round(avg(CASE WHEN coalesce(s, 0) > 30 THEN 1.0::double ELSE 0 END), 6) AS edge_density FROM s GROUP BY image_id"""
)
def raster_edges(spark, d):
    return rounded(px.edge_density(raster(spark)))


@query(
    f"""WITH RECURSIVE {_PIX}, lv AS (SELECT image_id, 7 AS level, y, x, b::double AS b FROM p UNION ALL SELECT image_id, level, y, x, b FROM (SELECT image_id, level - 1 AS level, y // 2 AS y, x // 2 AS x, avg(b) AS b FROM lv WHERE level > 0 GROUP BY ALL))
SELECT image_id, CAST(level AS INT) AS level, count(*) AS n, round(avg(b), 6) AS b, CAST(max(x // 32) AS BIGINT) AS last_tile FROM lv GROUP BY image_id, level"""
)
def pyramid_levels(spark, d):
    made = px.pyramid(raster(spark), WIDTH, HEIGHT, 32)
    return rounded(made.groupBy("image_id", "level").agg(F.count("*").alias("n"), F.avg("b").alias("b"), F.max("tile_x").alias("last_tile")))


@query("SELECT i AS tile_idx, i // 38 AS ty, i % 38 AS tx, (i % 38) * 9 AS x0, (i // 38) * 16 AS y0, greatest((i % 38 + 1) * 9 - 340, 0) AS pad_x, greatest((i // 38 + 1) * 16 - 500, 0) AS pad_y FROM range(38 * 32) r(i)")
def tile_grid(spark, d):
    return px.tile_grid(spark, 340, 500, 9, 16)


@query("SELECT file_hash, min(file_path) AS file_path FROM incoming WHERE file_hash IS NOT NULL GROUP BY file_hash")
def stream_append(spark, d):
    """The incoming files as a stream, one stored row per content: that of the least path."""
    folder = f"{shared_folder(spark).rstrip('/')}/append-{uuid.uuid4().hex}"
    schema = table(spark, d, "incoming").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/incoming.parquet*").select("file_hash", "file_path")
    append_new(spark, source, f"{folder}/library", "file_hash", f"{folder}/state")
    return spark.read.parquet(f"{folder}/library").select("file_hash", "file_path")


@query("SELECT run_id, category, count(*) AS n, min(loaded_at) AS first, max(loaded_at) AS last FROM winners GROUP BY ALL")
def stream_counters(spark, d):
    """Counters per run and category, kept over a stream of winners."""
    schema = table(spark, d, "winners").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/winners.parquet*").select("run_id", "category", F.col("loaded_at").alias("t"))
    return running_counts(spark, source, ["run_id", "category"])


@query()
def raster_canny(spark, d):
    return rounded(px.hysteresis_density(raster(spark)))
