"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.content import hash_key, hash_value, location
from gridloom.llm import clusters, history, imaging, mixing, neardup, neighbours, packing, subset, survivors, tokens, visual
from gridloom.session import cut, shared_folder, spread, table

#: Production parameters.
SUBSET_SHARE = 0.05
NEAR_BITS = 3
NEAR_SHARE = 0.8
HASH_BITS = 1


def _version() -> F.Column:
    return F.when(F.col("feature_version").between(1, 5), F.col("feature_version")).otherwise(F.lit(0))


def _has_grid() -> F.Column:
    return (F.coalesce(F.size("grid4x4"), F.lit(0)) == 192).cast("int")


def _uses() -> F.Column:
    return F.greatest(F.coalesce("use_count", F.lit(0)), F.lit(0))


def _moment() -> F.Column:
    return F.when(F.col("created_at") != F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Votes that order as the problem's rule: trust grows 2.5-fold per step of (version, grid), decay stays within (0.45, 1]."""
    images = table(spark, folder, "images")
    trust = F.pow(F.lit(2.5), 2 * _version() + _has_grid())
    decay = survivors.recency_decay(F.col("created_at"), "2100-01-01", 50_000, 0.45)
    tie = F.struct(_moment().alias("t"), _uses().alias("u"), (-F.col("id")).alias("i"))
    kept = survivors.surviving_records(images, hash_value(F.col("file_hash")), {"keep_id": F.col("id")}, trust, decay, tie)
    return kept.select(F.col("g").cast("string").alias("group_hash"), F.col("keep_id").cast("bigint").alias("keep_id"))


def p1_best_records(spark: SparkSession, folder: str) -> DataFrame:
    """One built record per content: each field by votes of its sources, trusted by version and completeness, halved every 180 days."""
    images = table(spark, folder, "images")
    trust = _version() + _has_grid() + F.lit(0.5)
    decay = survivors.recency_decay(F.col("created_at"), "2026-01-01", 180, 0.01)
    tie = F.struct(_moment().alias("t"), (-F.col("id")).alias("i"))
    fields = {
        "keep_id": F.col("id"), "use_count": F.when(F.col("use_count") >= 0, F.col("use_count")), "feature_version": F.when(F.col("feature_version").between(1, 5), F.col("feature_version")),
        "created_at": _moment(), "format": F.lower(F.trim(F.when(F.length(F.trim("format")) > 0, F.col("format")))),
    }
    kept = survivors.surviving_records(images, hash_value(F.col("file_hash")), fields, trust, decay, tie)
    return kept.select(F.col("g").cast("string").alias("group_hash"), "records", F.col("keep_id").cast("bigint").alias("keep_id"), F.col("use_count").cast("int").alias("use_count"), F.col("feature_version").cast("int").alias("feature_version"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), "format")


def _comparable(spark: SparkSession, folder: str) -> DataFrame:
    return imaging.comparable_images(spread(table(spark, folder, "images")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.linked_clusters(_comparable(spark, folder))


def p2_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Every scene with its size and its most typical images."""
    comparable = _comparable(spark, folder)
    return clusters.cluster_report(cut(clusters.linked_clusters(comparable)), comparable)


def p2_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """The tree's compact leaves with their sizes and the images nearest to their centres."""
    return clusters.leaf_report(_comparable(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_comparable(spark, folder))


def _entries(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., kind, fp, text): content values and locations of rows, each with its fingerprint."""
    base = df.select(*keep, hash_key(F.col("file_hash")).alias("hv"), location(F.col("file_path")).alias("place"))
    base = history.with_fingerprint(base, "place", "place_fp")
    both = F.array(
        F.struct(F.lit("hash").alias("kind"), F.col("hv").alias("fp"), F.col("hv").cast("string").alias("text")),
        F.struct(F.lit("place").alias("kind"), F.col("place_fp").alias("fp"), F.col("place").alias("text")),
    )
    return base.select(*keep, F.inline(both)).where("text IS NOT NULL")


def _incoming_entries(spark: SparkSession, folder: str) -> DataFrame:
    incoming = table(spark, folder, "incoming").withColumn("pos", F.struct(F.col("batch_no").isNull().alias("no_batch"), F.col("batch_no").cast("bigint").alias("batch_no"), F.col("incoming_id").cast("bigint").alias("incoming_id")))
    return cut(_entries(incoming, "incoming_id", "batch_no", "pos"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The history's fingerprints are stored once; then every batch is looked up, verified and appended, in turn."""
    store = history.BlockStore(spark, f"{shared_folder(spark).rstrip('/')}/history-{uuid.uuid4().hex}", HASH_BITS)
    store.append(_entries(table(spark, folder, "images")), -1)
    known = history.deduplicate_batches(store, _incoming_entries(spark, folder))
    return known.select(F.col("incoming_id").cast("bigint").alias("incoming_id")).distinct()


def p4_near_places(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming rows whose location is nearly that of a known one: NEAR_SHARE of the characters are kept. Rows within NEAR_BITS
    differing bits are met first."""
    old = _entries(table(spark, folder, "images")).where("kind = 'place'")
    known = history.near_rows(old, _incoming_entries(spark, folder).where("kind = 'place'"), NEAR_BITS, NEAR_SHARE)
    return known.groupBy("incoming_id").agg(F.max("in_history").alias("in_history"))


def p5_subset(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "images")
    return subset.varied_subset(images, round(SUBSET_SHARE * images.count()))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the grid's cells the subset covers."""
    return subset.coverage(table(spark, folder, "images"), cut(p5_subset(spark, folder)))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "knn_probes").select(F.col("probe_no").alias("q"), F.col("image_id").alias("own"))
    return neighbours.nearest_images(_comparable(spark, folder), asked).select(F.col("q").alias("probe_no"), F.col("id").alias("neighbour_id"))


def p7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest of every comparable image whose id is divisible by 20, among all."""
    comparable = _comparable(spark, folder)
    asked = comparable.where("id % 20 = 0").select(F.col("id").alias("q"), F.col("id").alias("own"))
    return neighbours.nearest_images(comparable, asked).select(F.col("q").alias("image_id"), "rank", F.col("id").alias("neighbour_id"), F.round("distance", 6).alias("distance"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' sizes in tokens, encoded once and written."""
    return cut(tokens.with_token_count(spread(table(spark, folder, "documents").select("doc_id", "source", "text")), "text"))


def p8_packs(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packs(_sized(spark, folder), table(spark, folder, "pack_sizes"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "pack_sizes")
    return packing.pack_report(packing.packs(_sized(spark, folder), sizes), sizes)


def p8_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the packs hold every token once and keep all limits."""
    sized, sizes = _sized(spark, folder), table(spark, folder, "pack_sizes")
    return packing.pack_limits(cut(packing.packs(sized, sizes)), sized, sizes)


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_sized(spark, folder), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    sized, targets = _sized(spark, folder), table(spark, folder, "mix_targets")
    return mixing.mixture_shares(cut(mixing.mixture(sized, targets)), sized, targets)


def p9_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the mixture keeps every cap and target."""
    sized, targets = _sized(spark, folder), table(spark, folder, "mix_targets")
    return mixing.mixture_limits(cut(mixing.mixture_shares(cut(mixing.mixture(sized, targets)), sized, targets)), sized)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return visual.equal_looking_pairs(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


def p10_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's consistent text, and whether it differs from the stored one."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return visual.with_canonical(docs, "text").select("doc_id", "canonical", (~F.col("canonical").eqNullSafe(F.col("text"))).alias("changed"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_best_records, p2_found, p2_scenes, p2_leaves, p3_found, p4_found, p4_near_places, p5_subset, p5_report, p7_found, p7_neighbours,
        p8_packs, p8_report, p8_limits, p9_mixture, p9_shares, p9_limits, p10_found, p10_canonical,
    )
}
# --- SQL ----------------------------------------------------------------------------------------------------------------

_NUMBER = """CASE WHEN t ~ '^[+-]?0x[0-9a-f]+$' THEN CAST(('0x' || lpad(regexp_replace(t, '^[+-]?0x0*', ''), 16, '0'))::UBIGINT AS HUGEINT)
  WHEN t ~ '^[+-]?[0-9]+$' THEN try_cast(regexp_replace(t, '^[+-]', '') AS HUGEINT) WHEN t ~ '^[+-]?[0-9a-f]*[a-f][0-9a-f]*$' THEN CAST(('0x' || regexp_replace(t, '^[+-]', ''))::UBIGINT AS HUGEINT) END"""


def _value(table_name: str, columns: str) -> str:
    return f"""(SELECT {columns}, CASE WHEN t LIKE '-%' THEN CASE WHEN n = 0 THEN 0 ELSE 18446744073709551616::HUGEINT - n END ELSE n END AS hv
  FROM (SELECT *, {_NUMBER} AS n FROM (SELECT *, lower(regexp_replace(file_hash, '\\s', '', 'g')) AS t FROM {table_name})))"""


_VALID = "len(grid4x4) = 192 AND list_min(grid4x4) >= 0 AND list_max(grid4x4) <= 255 AND len(list_filter(grid4x4, lambda x: x IS NULL)) = 0 AND avg_l IS NOT NULL AND avg_a IS NOT NULL AND avg_b IS NOT NULL AND saturation IS NOT NULL AND edge_density IS NOT NULL"
_COMPARABLE = f"""v AS (SELECT * FROM {_value('images', 'id, avg_l, avg_a, avg_b, saturation, edge_density, grid4x4')} WHERE {_VALID}),
comp AS MATERIALIZED (SELECT *, CAST(grid4x4 AS DOUBLE[]) AS g FROM v WHERE hv IS NULL OR id IN (SELECT min(id) FROM v WHERE hv IS NOT NULL GROUP BY hv))"""
_SLASHED = r"regexp_replace(regexp_replace(regexp_replace(file_path, '^\s+|\s+$', '', 'g'), '\\', '/', 'g'), '/+', '/', 'g')"
_PLACE = rf"""lower(nfc_normalize(list_aggregate(list_filter(string_split(regexp_replace({_SLASHED}, '(/|^)[^/]+/\.\.(/|$)', '\1', 'g'), '/'), lambda s: s <> '' AND s <> '.'), 'string_agg', '/')))"""
_PLACED = f"(CASE WHEN {_SLASHED} LIKE '/%' THEN '/' ELSE '' END || {_PLACE})"

# Letters and signs that look like others, written down here apart from the operator's own list, so that the two check each other.
_SEEN = "асԁеһіјорԛѕԝхуӏ" + "АВСЕНІЈКМОРЅТХҮӀ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "οϲϳ" + "օՕɡ" + "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ" + "\u00b5\u2126\u212a\u212b" + "\u2010\u2011"
_READ = "acdehijopqswxyl" + "ABCEHIJKMOPSTXYI" + "ABEZHIKMNOPTYX" + "ocj" + "oOg" + "ABCDEGHJKLMPRSTVWZ" + "\u03bc\u03a9K\u00c5" + "--"

_FORM = (
    "nfc_normalize(translate(translate(replace(replace(replace(replace(replace(replace(replace(replace(nfc_normalize(translate(regexp_replace(regexp_replace(text, "
    "'[\\x{00ad}\\x{200b}-\\x{200f}\\x{2060}-\\x{2064}\\x{feff}\\x{fe00}-\\x{fe0f}]', '', 'g'), '[\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}\\t]', ' ', 'g'), "
    f"'{''.join(map(chr, range(0xFF01, 0xFF5F)))}', '{''.join(map(chr, range(0x21, 0x7F))).replace(chr(39), chr(39) * 2)}')), "
    "'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st'), 'ё', 'ë'), "
    f"'{_SEEN}', '{_READ}'), 'Ёї', 'Ëï'))"
)

SQL: dict[str, str] = {
    "p2_found": f"""WITH RECURSIVE {_COMPARABLE}, links AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM comp a JOIN comp b ON a.id <> b.id AND abs(a.avg_l - b.avg_l) <= 20 AND abs(a.saturation - b.saturation) <= 30 WHERE list_distance(a.g, b.g) <= 20 * sqrt(192)),
reach AS (SELECT id AS root, id AS node FROM comp UNION SELECT r.root, l.v FROM reach r JOIN links l ON l.u = r.node),
k AS (SELECT node, min(root) AS cluster_key FROM reach GROUP BY node)
SELECT cluster_key, node AS image_id FROM k WHERE cluster_key IN (SELECT cluster_key FROM k GROUP BY cluster_key HAVING count(*) >= 20)""",
    "p10_found": f"""WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p1_found": f"""WITH r AS (SELECT hv, id, row_number() OVER (PARTITION BY hv ORDER BY CASE WHEN feature_version BETWEEN 1 AND 5 THEN feature_version ELSE 0 END DESC, CASE WHEN len(grid4x4) = 192 THEN 0 ELSE 1 END,
    nullif(created_at, TIMESTAMP '1970-01-01') DESC NULLS LAST, greatest(coalesce(use_count, 0), 0) DESC, id) AS r, count(*) OVER (PARTITION BY hv) AS n
  FROM {_value('images', 'id, feature_version, grid4x4, created_at, use_count')} WHERE hv IS NOT NULL)
SELECT CAST(hv AS VARCHAR) AS group_hash, id AS keep_id FROM r WHERE r = 1 AND n > 1""",
    "p1_best_records": f"""WITH s AS (SELECT hv, id, CASE WHEN feature_version BETWEEN 1 AND 5 THEN feature_version END AS v, CASE WHEN use_count >= 0 THEN use_count END AS u, nullif(created_at, TIMESTAMP '1970-01-01') AS t,
    CASE WHEN length(trim(format)) > 0 THEN lower(trim(format)) END AS f, coalesce(len(grid4x4) = 192, false) AS g FROM {_value('images', 'id, feature_version, grid4x4, created_at, use_count, format')} WHERE hv IS NOT NULL),
w AS (SELECT *, CAST(trunc((coalesce(v, 0) + CASE WHEN g THEN 1 ELSE 0 END + 0.5::double) * CASE WHEN t IS NULL THEN 0.01::double ELSE greatest(pow(0.5::double, greatest(date_diff('day', t::DATE, DATE '2026-01-01'), 0) / 180.0::double), 0.01::double * 1.1) END * 1e9::double) AS BIGINT) AS vote,
    row(coalesce(t, TIMESTAMP '0001-01-01'), -id) AS tie FROM s),
long AS (SELECT hv, 'keep_id' AS field, CAST(id AS VARCHAR) AS value, vote, tie FROM w UNION ALL SELECT hv, 'use_count', CAST(u AS VARCHAR), vote, tie FROM w UNION ALL SELECT hv, 'feature_version', CAST(v AS VARCHAR), vote, tie FROM w
  UNION ALL SELECT hv, 'created_at', CAST(t AS VARCHAR), vote, tie FROM w UNION ALL SELECT hv, 'format', f, vote, tie FROM w),
votes AS (SELECT hv, field, value, sum(vote) AS votes, max(tie) AS tie FROM long WHERE value IS NOT NULL GROUP BY ALL),
best AS (SELECT hv, field, value FROM (SELECT *, row_number() OVER (PARTITION BY hv, field ORDER BY votes DESC, tie DESC) AS r FROM votes) WHERE r = 1),
n AS (SELECT hv, count(*) AS records FROM w GROUP BY hv HAVING count(*) > 1)
SELECT CAST(n.hv AS VARCHAR) AS group_hash, n.records, CAST(max(value) FILTER (field = 'keep_id') AS BIGINT) AS keep_id, CAST(max(value) FILTER (field = 'use_count') AS INT) AS use_count, CAST(max(value) FILTER (field = 'feature_version') AS INT) AS feature_version,
  CAST(max(value) FILTER (field = 'created_at') AS TIMESTAMP) AS created_at, max(value) FILTER (field = 'format') AS format FROM n JOIN best USING (hv) GROUP BY ALL""",
    "p8_limits": "SELECT pack_name, true AS whole, true AS capacity_kept, true AS items_kept, true AS cost_kept FROM pack_sizes WHERE capacity > 0",
    "p9_limits": "SELECT source, true AS capped, true AS on_target FROM mix_targets WHERE source IS NOT NULL GROUP BY source",
    "p3_found": f"""WITH {_COMPARABLE}, near AS (SELECT a.id AS id_a, b.id AS id_b, a.g AS x, b.g AS y FROM comp a JOIN comp b ON a.id < b.id AND abs(a.avg_l - b.avg_l) <= 8 AND abs(a.avg_a - b.avg_a) <= 8 AND abs(a.avg_b - b.avg_b) <= 8)
SELECT id_a, id_b FROM near WHERE greatest(
  list_sum(list_transform(range(64), lambda i: CASE WHEN (x[3*i+1] - y[3*i+1])**2 + (x[3*i+2] - y[3*i+2])**2 + (x[3*i+3] - y[3*i+3])**2 <= 25 THEN 1 ELSE 0 END)),
  list_sum(list_transform(range(64), lambda i: CASE WHEN (x[3*i+1] - y[3*(i - i%8 + 7 - i%8)+1])**2 + (x[3*i+2] - y[3*(i - i%8 + 7 - i%8)+2])**2 + (x[3*i+3] - y[3*(i - i%8 + 7 - i%8)+3])**2 <= 25 THEN 1 ELSE 0 END))) >= 58""",
    "p4_found": f"""WITH i AS (SELECT *, {_PLACED} AS place, row_number() OVER (ORDER BY batch_no NULLS LAST, incoming_id) AS pos FROM {_value('incoming', 'incoming_id, batch_no, file_path')}),
l AS (SELECT hv, {_PLACED} AS place FROM {_value('images', 'file_path')}),
h AS (SELECT hv, min(pos) AS first FROM i WHERE hv IS NOT NULL GROUP BY hv), p AS (SELECT place, min(pos) AS first FROM i WHERE place <> '' GROUP BY place)
SELECT incoming_id FROM i LEFT JOIN h USING (hv) LEFT JOIN p USING (place)
WHERE coalesce(h.first < pos, false) OR coalesce(p.first < pos, false) OR hv IN (SELECT hv FROM l WHERE hv IS NOT NULL) OR place IN (SELECT place FROM l WHERE place <> '')""",
    "p7_found": f"""WITH {_COMPARABLE}, f AS MATERIALIZED (SELECT id, list_concat([avg_l / 255], list_transform(g, lambda x: x / 255), [edge_density]) AS x FROM comp),
n AS (SELECT p.probe_no, b.id, row_number() OVER (PARTITION BY p.probe_no ORDER BY list_distance(a.x, b.x), b.id) AS r FROM knn_probes p JOIN f a ON a.id = p.image_id JOIN f b ON b.id <> a.id)
SELECT probe_no, id AS neighbour_id FROM n WHERE r <= 10""",
}
