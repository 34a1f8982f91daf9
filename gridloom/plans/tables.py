"""Queries over the library, usage and winners tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.content import hash_value
from gridloom.operators import analysis, library, upkeep
from gridloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


_RANGES = ", ".join(f"round(min(avg_{c}), 6) AS min_{c}, round(max(avg_{c}), 6) AS max_{c}, round(avg(avg_{c}), 6) AS mean_{c}" for c in "lab")
_BANDS = "count(*) FILTER (avg_l < {0}) AS dark, count(*) FILTER (avg_l >= {0} AND avg_l < {1}) AS mid, count(*) FILTER (avg_l >= {1}) AS bright"
_MERGED = """merged AS (
  SELECT image_id, b.total_runs AS total_runs, b.total_tiles AS total_tiles, b.last_used AS last_used FROM (
    SELECT image_id, arg_max(u, row(coalesce(total_tiles, -1), coalesce(total_runs, -1), coalesce(last_used, TIMESTAMP '0001-01-01'))) AS b
    FROM usage_stats u WHERE image_id > 0 GROUP BY image_id))"""


@query(f"SELECT count(*) AS total, {_RANGES}, {_BANDS.format(30, 70)} FROM images")
def library_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(library.library_stats(table(spark, d, "images")))


@query(
    """SELECT CAST(b.bin AS INT) AS bin, (b.bin * 32) || '-' || (b.bin * 32 + 31) AS label, count(i.avg_l) AS n
FROM range(8) b(bin) LEFT JOIN images i ON least(greatest(floor(i.avg_l / 32), 0), 7) = b.bin GROUP BY b.bin"""
)
def l_histogram(spark, d):
    return library.l_histogram(table(spark, d, "images"))


@query(
    f"""WITH s AS (SELECT count(*) AS total, {_RANGES}, {_BANDS.format(30, 70)} FROM images)
SELECT 'dark_mid' AS rule, 'few dark and medium images' AS message FROM s WHERE dark + mid < floor(total / 100)
UNION ALL SELECT 'min_a', 'no strong green' FROM s WHERE min_a > 110 UNION ALL SELECT 'max_a', 'no strong red' FROM s WHERE max_a < 145
UNION ALL SELECT 'min_b', 'no strong blue' FROM s WHERE min_b > 110 UNION ALL SELECT 'max_b', 'no strong yellow' FROM s WHERE max_b < 145"""
)
def coverage_gaps(spark, d):
    return library.coverage_gaps(table(spark, d, "images"))


#: The unsigned value a hash text denotes, for the SQL side.
_HASHED = r"""(SELECT *, CASE WHEN h LIKE '-%' AND m > 0 THEN 18446744073709551616::HUGEINT - m ELSE m END AS hv FROM (SELECT *,
  CASE WHEN regexp_full_match(h, '[+-]?[0-9]+') THEN TRY_CAST(ltrim(h, '+-') AS HUGEINT)
       WHEN regexp_full_match(h, '[+-]?(0x)?[0-9a-f]+') THEN CAST(TRY_CAST('0x' || regexp_replace(ltrim(h, '+-'), '^0x', '') AS UBIGINT) AS HUGEINT) END AS m
  FROM (SELECT *, lower(regexp_replace(file_hash, '\s', '', 'g')) AS h FROM {})))"""

_HOT = """kept AS (SELECT m.* FROM merged m SEMI JOIN images i ON i.id = m.image_id),
r AS (SELECT *, row_number() OVER (ORDER BY total_runs DESC NULLS LAST, image_id) AS r, count(*) OVER () AS used FROM kept),
hot AS (SELECT max(used) AS used, max(greatest(floor(used / 100), 1)) AS top, sum(total_tiles) FILTER (r <= greatest(floor(used / 100), 1)) AS hotspot_tiles, sum(total_tiles) AS all_tiles FROM r)"""


@query(f"WITH {_MERGED}, {_HOT} SELECT used, CAST(top AS BIGINT) AS top, CAST(hotspot_tiles AS BIGINT) AS hotspot_tiles, CAST(all_tiles AS BIGINT) AS all_tiles, round(100.0::double * hotspot_tiles / all_tiles, 6) AS hotspot_pct FROM hot")
def usage_hotspot(spark, d):
    return rounded(library.hotspot_share(library.library_usage(table(spark, d, "images"), table(spark, d, "usage_stats"))))


@query(
    f"""WITH {_MERGED}, {_HOT}, b AS (SELECT count(*) AS total, {_BANDS.format(50, 150)}, min(avg_a) AS min_a, max(avg_a) AS max_a, min(avg_b) AS min_b, max(avg_b) AS max_b FROM images),
x AS (SELECT *, 100.0::double * hotspot_tiles / all_tiles AS hp, total - used AS unused, 100.0::double * dark / total AS dp, 100.0::double * mid / total AS mp, 100.0::double * bright / total AS bp FROM b, hot)
SELECT total, dark, mid, bright, round(dp, 6) AS dark_pct, round(mp, 6) AS mid_pct, round(bp, 6) AS bright_pct, round(min_a, 6) AS min_a, round(max_a, 6) AS max_a, round(min_b, 6) AS min_b, round(max_b, 6) AS max_b,
  used, unused, round(100.0::double * used / total, 6) AS used_pct, round(100.0::double * unused / total, 6) AS unused_pct, round(hp, 6) AS hotspot_pct,
  dp < 5 AS warn_dark, mp < 15 AS warn_mid, min_a > 115 AS warn_min_a, max_a < 140 AS warn_max_a, min_b > 115 AS warn_min_b, max_b < 140 AS warn_max_b,
  unused > total // 2 AS warn_unused, hp > 20 AS warn_hotspot,
  concat_ws(',', CASE WHEN dp < 5 THEN 'dark' END, CASE WHEN mp < 15 THEN 'mid' END, CASE WHEN min_a > 115 OR max_a < 140 THEN 'green_red' END, CASE WHEN min_b > 115 OR max_b < 140 THEN 'blue_yellow' END, CASE WHEN unused > total // 2 THEN 'unused' END) AS advice FROM x"""
)
def health_report(spark, d):
    return rounded(library.health_report(table(spark, d, "images"), table(spark, d, "usage_stats")))


@query("SELECT id, file_path, use_count, round(avg_l, 6) AS avg_l FROM images WHERE avg_l BETWEEN 80 AND 120 ORDER BY use_count NULLS LAST, id LIMIT 200")
def l_range_scan(spark, d):
    return rounded(library.l_range(table(spark, d, "images"), 80, 120, 200).select("id", "file_path", "use_count", "avg_l"))


@query("SELECT id FROM images WHERE avg_l BETWEEN 80 AND 120")
def l_range_ids(spark, d):
    return library.l_range(table(spark, d, "images"), 80, 120).select("id")


@query("SELECT count(*) AS total FROM images")
def total_count(spark, d):
    return table(spark, d, "images").agg(F.count("*").alias("total"))


@query("SELECT w.key, coalesce(max(nullif(trim(m.value), '')), w.fallback) AS value FROM (VALUES ('feature_w', '0'), ('feature_h', '0'), ('note', 'none'), ('absent', 'none')) w(key, fallback) LEFT JOIN meta m ON m.key = w.key GROUP BY w.key, w.fallback")
def meta_lookup(spark, d):
    want = spark.createDataFrame([("feature_w", "0"), ("feature_h", "0"), ("note", "none"), ("absent", "none")], "key string, fallback string")
    got = table(spark, d, "meta").groupBy("key").agg(F.max(F.when(F.trim("value") != "", F.trim("value"))).alias("value"))
    return want.join(got, "key", "left").select("key", F.coalesce("value", "fallback").alias("value"))


@query(f"SELECT incoming_id FROM {_HASHED.format('incoming')} WHERE hv IN (SELECT hv FROM {_HASHED.format('images')} WHERE hv IS NOT NULL)")
def hash_exists(spark, d):
    return library.known_hashes(table(spark, d, "incoming").select("incoming_id", "file_hash"), table(spark, d, "images")).select("incoming_id")


@query(
    f"""SELECT id, file_hash FROM (SELECT id, file_hash, hv, row_number() OVER (PARTITION BY hv ORDER BY file_path, id) AS r FROM {_HASHED.format('images')}) WHERE r = 1 OR hv IS NULL"""
)
def dedup_content_hash(spark, d):
    return library.first_of_content(table(spark, d, "images").select("id", "file_hash", "file_path"), hash_value(F.col("file_hash")), ["file_path", "id"]).select("id", "file_hash")


@query(
    f"""WITH f AS (SELECT file_hash, file_path, hv, row_number() OVER (PARTITION BY hv ORDER BY file_path, file_hash) AS r FROM (SELECT DISTINCT file_hash, file_path, hv FROM {_HASHED.format('incoming')})),
p AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY file_hash NULLS FIRST) AS q FROM f WHERE r = 1 OR hv IS NULL)
SELECT file_hash, file_path, true AS known FROM images
UNION ALL SELECT file_hash, file_path, false FROM p WHERE (q = 1 OR file_path IS NULL)
  AND (hv IS NULL OR hv NOT IN (SELECT hv FROM {_HASHED.format('images')} WHERE hv IS NOT NULL)) AND (file_path IS NULL OR file_path NOT IN (SELECT file_path FROM images WHERE file_path IS NOT NULL))"""
)
def append_build(spark, d):
    return library.append_build(table(spark, d, "images"), table(spark, d, "incoming"))


@query("SELECT i.id, i.file_path FROM images i WHERE NOT EXISTS (SELECT 1 FROM usage_stats u WHERE u.image_id = i.id)")
def unused_images(spark, d):
    return library.unused_images(table(spark, d, "images"), table(spark, d, "usage_stats"))


@query("SELECT image_id, total_runs, total_tiles, last_used FROM usage_stats ORDER BY total_runs DESC NULLS LAST, total_tiles DESC NULLS LAST, image_id NULLS FIRST, last_used NULLS FIRST LIMIT 50")
def usage_topk(spark, d):
    return library.top_used(table(spark, d, "usage_stats"), 50)


@query(f"WITH {_MERGED} SELECT image_id, total_runs, total_tiles, last_used FROM merged")
def usage_merged(spark, d):
    return library.merged_usage(table(spark, d, "usage_stats"))


@query(
    rf"""WITH {_MERGED}, x AS (SELECT m.*, i.file_path, row_number() OVER (ORDER BY m.total_tiles DESC NULLS LAST, m.image_id) AS rank FROM merged m LEFT JOIN images i ON i.id = m.image_id)
SELECT image_id, rank, 'rank' || CASE WHEN rank < 10000 THEN lpad(CAST(rank AS VARCHAR), 4, '0') ELSE CAST(rank AS VARCHAR) END || '_' || total_runs || 'runs_' || total_tiles || 'tiles_id' || image_id || coalesce(regexp_extract(file_path, '(\.[^./\\]+)$', 1), '') AS file_name,
  file_path IS NOT NULL AS found FROM x"""
)
def usage_export(spark, d):
    return library.usage_export(table(spark, d, "usage_stats"), table(spark, d, "images"))


@query(
    f"""WITH {_MERGED}, used AS (SELECT image_id, target_hash, count(*) AS tiles FROM winners WHERE image_id > 0 GROUP BY ALL),
u2 AS (SELECT image_id, count(*) FILTER (target_hash IS NOT NULL AND target_hash NOT IN (SELECT target_hash FROM target_runs WHERE target_hash IS NOT NULL)) AS total_runs, sum(tiles) AS total_tiles FROM used GROUP BY image_id)
SELECT image_id, CAST(sum(total_runs) AS BIGINT) AS total_runs, CAST(sum(total_tiles) AS BIGINT) AS total_tiles FROM (SELECT image_id, total_runs, total_tiles FROM merged UNION ALL SELECT * FROM u2) GROUP BY image_id"""
)
def usage_upsert_merge(spark, d):
    return library.recorded_usage(table(spark, d, "usage_stats"), table(spark, d, "winners"), table(spark, d, "target_runs"))


@query(
    """SELECT target_hash, count(*) AS versions, max(run_count) AS run_count, max(last_used) AS last_used FROM target_runs GROUP BY target_hash"""
)
def target_ledger(spark, d):
    return table(spark, d, "target_runs").groupBy("target_hash").agg(F.count("*").alias("versions"), F.max("run_count").alias("run_count"), F.max("last_used").alias("last_used"))


@query("SELECT key, CASE WHEN key = 'feature_version' THEN '6' ELSE value END AS value FROM meta UNION ALL SELECT 'built', 'yes'")
def meta_upsert(spark, d):
    changes = spark.createDataFrame([("feature_version", "6"), ("built", "yes")], "key string, value string")
    return library.upsert(table(spark, d, "meta"), changes, "key")


@query("SELECT id, file_path FROM images WHERE id NOT IN (SELECT image_id FROM usage_stats WHERE image_id IS NOT NULL AND total_runs > 1)")
def remove_rows(spark, d):
    gone = table(spark, d, "usage_stats").where("total_runs > 1").select(F.col("image_id").alias("id"))
    return table(spark, d, "images").select("id", "file_path").join(gone, "id", "left_anti")


@query("SELECT i.id, CASE WHEN len(i.grid4x4) = 192 THEN true ELSE false END AS whole, CASE WHEN len(i.grid4x4) = 192 THEN round(list_sum(i.grid4x4)::double, 1) ELSE 0 END AS total FROM images i")
def pack_alignment(spark, d):
    whole = F.coalesce(F.size("grid4x4") == 192, F.lit(False))
    grid = F.when(whole, F.col("grid4x4")).otherwise(F.array_repeat(F.lit(0).cast("float"), 192))
    return table(spark, d, "images").select("id", whole.alias("whole"), F.round(F.aggregate(grid, F.lit(0.0), lambda s, v: s + v), 1).alias("total"))


@query(
    """WITH old AS (SELECT id, count(*) AS c, min(edge_density) AS e FROM images WHERE feature_version <= 3 GROUP BY id)
SELECT i.id, round(coalesce(o.e, i.edge_density), 6) AS edge_density, o.id IS NOT NULL AS reused FROM images i LEFT JOIN old o ON o.id = i.id"""
)
def pack_merge(spark, d):
    """A pack brought up to date: rows of old versions are kept, the others come from the library."""
    images = table(spark, d, "images")
    pack = images.where("feature_version <= 3").select("id", "edge_density")
    return rounded(upkeep.aligned_pack(upkeep.merged_pack(pack, images.select("id", "edge_density"), images), images))


@query("SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS as_text, CAST(epoch(date_trunc('second', created_at)) AS BIGINT) AS seconds FROM images WHERE created_at IS NOT NULL")
def time_forms(spark, d):
    """Times as UTC text and as whole Unix seconds."""
    at = F.col("created_at")
    return table(spark, d, "images").where("created_at IS NOT NULL").select("id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("as_text"), F.unix_seconds(F.date_trunc("second", at).cast("timestamp")).alias("seconds"))


@query(
    f"""SELECT p.probe_no AS q, count(*) AS n, CAST(count(*) FILTER (i.avg_l < 30) AS BIGINT) AS dark, CAST(count(*) FILTER (i.avg_l >= 30 AND i.avg_l < 70) AS BIGINT) AS mid,
  CAST(count(*) FILTER (i.avg_l >= 70) AS BIGINT) AS bright, round(min(i.avg_l), 6) AS min_l, round(max(i.avg_l), 6) AS max_l, round(avg(i.avg_l), 6) AS mean_l
FROM knn_probes p JOIN images o ON o.id = p.image_id JOIN images i ON abs(i.avg_l - o.avg_l) <= 20 GROUP BY p.probe_no"""
)
def l_band_join(spark, d):
    images = table(spark, d, "images")
    asked = table(spark, d, "knn_probes").join(images.select(F.col("id").alias("image_id"), F.col("avg_l").alias("l")), "image_id").select(F.col("probe_no").alias("q"), "l")
    return rounded(library.band_join(asked, images))


@query("SELECT run_id, image_id, count(*) AS n FROM winners WHERE image_id > 0 GROUP BY ALL")
def uses_per_run(spark, d):
    return table(spark, d, "winners").where("image_id > 0").groupBy("run_id", "image_id").agg(F.count("*").alias("n"))


_PCT = """WITH s AS (SELECT {g} AS g, {v} AS v, row_number() OVER (PARTITION BY {g} ORDER BY {v}) - 1 AS r, count(*) OVER (PARTITION BY {g}) AS n FROM winners WHERE {v} IS NOT NULL)
SELECT g AS {g}, max(n) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS most, round(max(v) FILTER (r = n // 2), 6) AS median, round(max(v) FILTER (r = n * 9 // 10), 6) AS p90,
  round(max(v) FILTER (r = n * 99 // 100), 6) AS p99 FROM s GROUP BY g"""


@query(_PCT.format(g="run_id", v="score"))
def score_percentiles(spark, d):
    return rounded(analysis.index_percentiles(table(spark, d, "winners"), "run_id", "score"))


@query(_PCT.format(g="category", v="gap"))
def gap_percentiles(spark, d):
    return rounded(analysis.index_percentiles(table(spark, d, "winners"), "category", "gap"))


@query("SELECT least(cand_rank + 1, 4) AS bucket, count(*) AS n FROM winners WHERE cand_rank >= 0 GROUP BY 1")
def rank_buckets(spark, d):
    return analysis.rank_buckets(table(spark, d, "winners"))


@query("SELECT CAST(k AS INT) AS k, round(avg(CASE WHEN cand_rank < k THEN 1.0::double ELSE 0 END), 6) AS share FROM winners, (VALUES (1), (5), (10), (20), (50)) t(k) WHERE cand_rank >= 0 GROUP BY k")
def recall_at_k(spark, d):
    return rounded(analysis.recall_at(table(spark, d, "winners")))


@query("SELECT category, count(*) AS n, round(avg(score), 6) AS mean_score FROM winners GROUP BY category")
def category_scores(spark, d):
    return rounded(analysis.category_scores(table(spark, d, "winners")))


_COUNTS = "c AS (SELECT image_id, count(*) AS n FROM winners WHERE image_id > 0 GROUP BY image_id)"


@query(
    f"""WITH {_COUNTS}, t AS (SELECT sum(n) AS top FROM (SELECT n FROM c ORDER BY n DESC, image_id DESC LIMIT 10))
SELECT CAST(sum(n) AS BIGINT) AS tiles, count(*) AS images, round(sum(n)::double / count(*), 6) AS per_image, round((SELECT top FROM t)::double / sum(n), 6) AS top10 FROM c"""
)
def reuse_ratio(spark, d):
    return rounded(analysis.reuse(table(spark, d, "winners")))


@query(
    f"""WITH {_COUNTS} SELECT CASE WHEN n <= 3 THEN CAST(n AS VARCHAR) WHEN n <= 5 THEN '4-5' WHEN n <= 10 THEN '6-10' ELSE '>10' END AS uses, count(*) AS images, CAST(sum(n) AS BIGINT) AS tiles FROM c GROUP BY 1"""
)
def frequency_distribution(spark, d):
    return analysis.use_frequencies(table(spark, d, "winners"))


@query("SELECT CAST(b.bin AS INT) AS bin, count(w.score) AS n FROM range(10) b(bin) LEFT JOIN winners w ON least(greatest(floor(w.score * 30), 0), 9) = b.bin GROUP BY b.bin")
def score_histogram(spark, d):
    return analysis.score_histogram(table(spark, d, "winners"))


@query("SELECT run_id, tile_idx, image_id, round(score, 6) AS score FROM (SELECT DISTINCT run_id, tile_idx, image_id, score FROM winners ORDER BY score DESC NULLS LAST, tile_idx DESC NULLS LAST, run_id DESC NULLS LAST, image_id DESC NULLS LAST LIMIT 20)")
def worst_n(spark, d):
    return rounded(analysis.worst_tiles(table(spark, d, "winners"), 20))


@query(
    """WITH r AS (SELECT DISTINCT run_id, tile_idx, image_id FROM winners WHERE image_id > 0 AND tile_idx IS NOT NULL)
SELECT run_id, tile_idx, image_id, count(*) OVER (PARTITION BY run_id, image_id ORDER BY tile_idx RANGE BETWEEN 300 PRECEDING AND 1 PRECEDING) AS recent, tile_idx - lag(tile_idx) OVER (PARTITION BY run_id, image_id ORDER BY tile_idx) AS gap FROM r"""
)
def sliding_reuse(spark, d):
    return analysis.reuse_windows(table(spark, d, "winners"), 300)


@query(
    """WITH r AS (SELECT run_id, tile_idx, max(score) AS s FROM winners WHERE score IS NOT NULL AND tile_idx IS NOT NULL GROUP BY ALL), e AS (SELECT *, min(s) OVER (PARTITION BY run_id) AS lo, max(s) OVER (PARTITION BY run_id) AS hi FROM r),
h AS (SELECT run_id, tile_idx, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0 END AS heat FROM e)
SELECT run_id, tile_idx, round(heat, 6) AS heat, CASE WHEN heat < 1.0::double / 3 THEN 'green' WHEN heat < 2.0::double / 3 THEN 'yellow' ELSE 'red' END AS colour FROM h"""
)
def heatmap_minmax(spark, d):
    return rounded(analysis.heatmap(table(spark, d, "winners")))


@query(
    SQL["heatmap_minmax"].split("SELECT run_id, tile_idx, round(heat, 6)")[0]
    + "SELECT run_id, tile_idx, 0 AS b, CAST(floor(255 * CASE WHEN heat < 0.5 THEN heat * 2 ELSE 1 - (heat - 0.5) * 2 END) AS INT) AS g, CASE WHEN heat < 0.5 THEN CAST(floor(255 * (1 - heat * 2)) AS INT) ELSE 255 END AS r FROM h"
)
def heat_colours(spark, d):
    return analysis.heat_ramp(analysis.heatmap(table(spark, d, "winners")))


@query(
    """SELECT count(*) AS tiles, count(i.id) AS matched, count(*) FILTER (coalesce(w.image_id, 0) <= 0) AS no_candidate, count(*) FILTER (w.image_id > 0 AND i.id IS NULL) AS load_fail, count(*) FILTER (w.gap IS NULL) AS no_gap
FROM winners w LEFT JOIN images i ON i.id = w.image_id"""
)
def match_counters(spark, d):
    return analysis.match_counters(table(spark, d, "winners"), table(spark, d, "images"))


@query("SELECT image_id, n FROM (SELECT image_id, count(*) AS n FROM winners WHERE image_id > 0 GROUP BY image_id) ORDER BY n DESC, image_id DESC LIMIT 10")
def most_used(spark, d):
    counts = table(spark, d, "winners").where("image_id > 0").groupBy("image_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.desc("image_id")).limit(10)


@query("SELECT run_id, image_id, count(*) AS n FROM winners WHERE image_id > 0 GROUP BY ALL HAVING count(*) >= 2")
def reused_images(spark, d):
    return table(spark, d, "winners").where("image_id > 0").groupBy("run_id", "image_id").agg(F.count("*").alias("n")).where("n >= 2")
