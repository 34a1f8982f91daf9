"""Queries over vectors and grids: distances, textures, nearest neighbours, re-ranking and selection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import vectors as v
from gridloom.operators import analysis, nearest, selector, upkeep
from gridloom.operators.analysis import index_percentiles
from gridloom.plans.tables import rounded
from gridloom.session import cut, shared_folder, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = 10
#: Library rows scored for each tile.
CANDIDATES = 150
#: Feature weights of the two-stage ranking: the stored features of the library.
WEIGHTS = {"lab": 0.20, "grid": 0.45, "edge": 0.05}
USE_PENALTY = 0.01


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("int").alias("label")))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec"))


def _knn_sql(distance: str, where: str = "true") -> str:
    return f"""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS id, {distance} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND {where})
SELECT q, CAST(rank AS INT) AS rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS rank FROM p) WHERE rank <= {K}"""


_L2 = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_IP = "1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_COS = "list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(_knn_sql(_L2))
def knn_l2_exact(spark, d):
    return rounded(nearest.knn(_rows(spark, d), _asked(spark, d), K))


@query(_knn_sql(_IP))
def knn_ip_exact(spark, d):
    return rounded(nearest.knn(_rows(spark, d), _asked(spark, d), K, "ip"))


@query(_knn_sql(_COS))
def knn_cosine(spark, d):
    return rounded(nearest.knn(_rows(spark, d), _asked(spark, d), K, "cosine"))


@query(_knn_sql(_L2, "b.label % 2 = 0"))
def knn_filtered(spark, d):
    return rounded(nearest.knn(_rows(spark, d), _asked(spark, d), K, where=F.col("label") % 2 == 0))


@query(_knn_sql(_L2, "b.vec_id % 7 <> 0"))
def knn_soft_deleted(spark, d):
    return rounded(nearest.knn(_rows(spark, d).withColumn("gone", F.col("id") % 7 == 0), _asked(spark, d), K, deleted="gone"))


@query(f"SELECT a.vec_id AS q, b.vec_id AS id, round({_L2}, 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND {_L2} <= 1.2")
def knn_epsilon(spark, d):
    return rounded(nearest.within(_rows(spark, d), _asked(spark, d), 1.2))


@query(_knn_sql(_L2, f"{_L2} <= 1.2").replace("CAST(rank AS INT) AS rank, ", ""))
def knn_epsilon_capped(spark, d):
    return rounded(nearest.within(_rows(spark, d), _asked(spark, d), 1.2, most=K))


@query(
    f"""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS id, b.label AS label, {_L2} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
f AS (SELECT q, label, min(distance) AS first FROM p GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY first, label) AS n FROM f)
SELECT p.q, p.id, round(p.distance, 6) AS distance, CAST(p.label AS INT) AS label FROM p LEFT JOIN n ON n.q = p.q AND n.n = 4 WHERE n.first IS NULL OR p.distance < n.first"""
)
def knn_grouped_docs(spark, d):
    return rounded(nearest.knn_documents(_rows(spark, d), _asked(spark, d), "label", 3))


@query(_knn_sql(_L2, "b.vec_id % 7 <> 0 AND b.vec_id % 11 <> 0"))
def knn_index_lifecycle(spark, d):
    """Build, remove, add again, mark deleted and unmark, then a search that probes every cell."""
    rows = _rows(spark, d)
    index = nearest.CellIndex.build(rows, 16)
    index = index.remove(rows.where("id % 7 = 0 OR id % 5 = 0")).add(rows.where("id % 5 = 0 AND id % 7 <> 0"))
    index = index.mark_deleted(rows.where("id % 11 = 0 OR id % 13 = 0")).mark_deleted(rows.where("id % 13 = 0 AND id % 11 <> 0"), False)
    return rounded(index.search(_asked(spark, d), K, 16))


@query()
def knn_cells_recall(spark, d):
    """(probes, recall): share of the exact neighbours found in 1, 4 and 16 of 16 cells."""
    rows, asked = _rows(spark, d), cut(_asked(spark, d))
    index = nearest.CellIndex.build(rows, 16)
    exact = cut(nearest.knn(rows, asked, K).select("q", "id"))
    made = None
    for probes in (1, 4, 16):
        hit = exact.join(index.search(asked, K, probes).select("q", "id", F.lit(1).alias("hit")), ["q", "id"], "left").agg(F.lit(probes).alias("probes"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
        made = hit if made is None else made.unionByName(hit)
    return made


@query(_knn_sql(_L2))
def knn_index_reloaded(spark, d):
    """A saved and reloaded index of 16 cells, its count checked, all of them probed."""
    rows = _rows(spark, d)
    path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    nearest.CellIndex.build(rows, 16).save(path)
    return rounded(nearest.CellIndex.load(spark, path, rows.where("vec IS NOT NULL").count()).search(_asked(spark, d), K, 16))


_BYTES = "list_transform(embedding, lambda x: floor((x + 1) * 127))"


@query(
    f"""WITH e AS (SELECT vec_id, CAST({_BYTES} AS DOUBLE[]) AS b FROM embeddings), p AS (SELECT x.vec_id AS q, y.vec_id AS id, CAST(round(list_distance(x.b, y.b)**2) AS BIGINT) AS distance FROM e x JOIN e y ON x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0)
SELECT q, CAST(rank AS INT) AS rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS rank FROM p) WHERE rank <= {K}"""
)
def knn_integer_l2(spark, d):
    """Nearest rows of vectors stored as bytes, by whole-number squared distances."""
    small = lambda df: df.withColumn("vec", F.transform("vec", lambda x: F.floor((x.cast("double") + 1) * 127).cast("float")))
    got = nearest.knn(small(_rows(spark, d)), small(_asked(spark, d)), K)
    return got.select("q", "rank", "id", F.round(F.col("distance") * F.col("distance")).cast("bigint").alias("distance"))


@query(
    f"""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_L2}, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
c AS (SELECT e.vec_id, count(p.id) AS n FROM embeddings e LEFT JOIN p ON p.id = e.vec_id AND p.r <= {K} GROUP BY e.vec_id)
SELECT count(*) AS rows, min(n) AS least, max(n) AS most, count(*) FILTER (n = 0) AS "none" FROM c"""
)
def knn_in_degree(spark, d):
    """How evenly rows are named as neighbours: every row asks for its nearest ones."""
    rows = _rows(spark, d)
    return upkeep.in_degrees(nearest.knn(rows, rows.select(F.col("id").alias("q"), "vec"), K), rows)


# --- grids of images ----------------------------------------------------------------------------------------------------

_GOOD = "len(g) = 192 AND list_min(g) >= 0 AND list_max(g) <= 255"
_W = "[" + ", ".join(str(w) + "::DOUBLE" for w in v.CELL_WEIGHTS) + "]"
_SQ = "((x.g[3*i+1] - y.g[3*i+1])**2 + (x.g[3*i+2] - y.g[3*i+2])**2 + (x.g[3*i+3] - y.g[3*i+3])**2)"
_IMG = "img AS (SELECT id, file_hash, avg_l, avg_a, avg_b, edge_density, use_count, CAST(grid4x4 AS DOUBLE[]) AS g FROM images)"


def _images(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "images").select("id", "file_hash", "avg_l", "avg_a", "avg_b", "edge_density", "use_count", F.col("grid4x4").alias("g")))


def _good() -> F.Column:
    """Whole grids of possible values."""
    return (F.size("g") == 192) & (F.array_min("g") >= 0) & (F.array_max("g") <= 255)


def _copies(spark: SparkSession, d: str) -> DataFrame:
    """Every image beside the first of its stored hash."""
    images = _images(spark, d).where("file_hash IS NOT NULL")
    first = images.groupBy("file_hash").agg(F.min_by(F.struct("id", "avg_l", "avg_a", "avg_b", "g"), "id").alias("first"))
    return images.join(first, "file_hash").where(F.col("id") != F.col("first.id"))


_COPIES = f"""{_IMG}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY id) AS r FROM img WHERE file_hash IS NOT NULL) WHERE r = 1),
c AS (SELECT x.*, y.id AS first_id, y.g AS yg, y.avg_l AS l2, y.avg_a AS a2, y.avg_b AS b2 FROM img x JOIN firsts y ON x.file_hash = y.file_hash AND x.id <> y.id)"""


def _terms(expr: str) -> str:
    return expr.replace("x.g[", "g[").replace("y.g[", "yg[")


@query(
    f"""WITH {_COPIES} SELECT id, first_id, round(sqrt((avg_l - l2)**2 + (avg_a - a2)**2 + (avg_b - b2)**2) / 100, 6) AS lab,
  CASE WHEN len(g) = 192 AND len(yg) = 192 THEN round(list_sum(list_transform(range(64), lambda i: sqrt({_terms(_SQ)}) * {_W}[i+1])) / 6400, 6) ELSE 1e6 END AS weighted,
  CASE WHEN len(g) = 192 AND len(yg) = 192 THEN round(list_sum(list_transform(range(64), lambda i: {_terms(_SQ)} * {_W}[i+1])) / 6400, 6) ELSE 1e6 END AS weighted_sq,
  CASE WHEN len(g) = len(yg) AND len(g) > 0 AND len(g) % 3 = 0 THEN round(list_sum(list_transform(range(len(g) // 3), lambda i: sqrt({_terms(_SQ)}))) / (len(g) / 3) / 100, 6) ELSE 1e6 END AS plain FROM c"""
)
def grid_distances(spark, d):
    c = _copies(spark, d)
    x, y = F.col("g"), F.col("first.g")
    return rounded(
        c.select(
            "id", F.col("first.id").alias("first_id"), v.lab_distance(F.col("avg_l"), F.col("avg_a"), F.col("avg_b"), F.col("first.avg_l"), F.col("first.avg_a"), F.col("first.avg_b")).alias("lab"),
            v.grid_distance(x, y).alias("weighted"), v.grid_distance(x, y, squared=True).alias("weighted_sq"), v.plain_grid_distance(x, y).alias("plain"),
        )
    )


@query(
    f"""WITH {_COPIES}, e AS (SELECT i AS cell, sqrt({_terms(_SQ)}) AS dist FROM c, (SELECT unnest(range(64)) AS i) WHERE len(g) = 192 AND len(yg) = 192),
m AS (SELECT cell, avg(dist) AS mean FROM e GROUP BY cell)
SELECT CAST(cell AS INT) AS cell, round(mean, 6) AS mean, round(1 / mean / (SELECT sum(1 / greatest(mean, 0.001)) FROM m) * 64, 5) AS weight FROM m"""
)
def grid_cell_contribution(spark, d):
    """Mean distance of every cell between copies, and the weights it suggests."""
    c = _copies(spark, d).where((F.size("g") == 192) & (F.size("first.g") == 192))
    cells = c.select(F.posexplode(v.cell_contributions(F.col("g"), F.col("first.g"))).alias("cell", "dist"))
    mean = cells.groupBy("cell").agg(F.avg("dist").alias("mean"))
    whole = mean.agg(F.sum(1 / F.greatest("mean", F.lit(0.001))).alias("whole"))
    return mean.crossJoin(F.broadcast(whole)).select("cell", F.round("mean", 6).alias("mean"), F.round(F.try_divide(F.lit(1.0), F.col("mean")) / F.col("whole") * 64, 5).alias("weight"))


_PLANE = "list_transform(range(64), lambda i: g[3*i+1])"
_TEX = f"""{_IMG}, p AS MATERIALIZED (SELECT id, edge_density, {_PLANE} AS p FROM img WHERE {_GOOD}),
codes AS MATERIALIZED (SELECT id, edge_density, p, list_transform(range(36), lambda k: list_sum(list_transform([[-9,1],[-8,2],[-7,4],[1,8],[9,16],[8,32],[7,64],[-1,128]], lambda s: CASE WHEN p[(k//6+1)*8 + k%6 + 2 + s[1]] >= p[(k//6+1)*8 + k%6 + 2] THEN s[2] ELSE 0 END))) AS codes FROM p),
t AS (SELECT id, edge_density, list_sum(list_transform(p, lambda v: v*v)) / 64 - (list_sum(p) / 64)**2 AS l_variance,
  list_sum(list_transform(list_distinct(codes), lambda c: -(len(list_filter(codes, lambda q: q = c)) / 36.0::double) * log2(len(list_filter(codes, lambda q: q = c)) / 36.0::double))) AS texture,
  len(list_filter(range(64), lambda i: i % 8 > 0 AND i >= 8 AND abs(p[i+1] - p[i]) + abs(p[i+1] - p[i-7]) > 30)) / 64.0::double AS gradient, list_sum(codes) AS code_sum FROM codes)"""
_CAT = "CASE WHEN edge_density < 0.005 AND l_variance < 100 THEN 'smooth' {0} WHEN edge_density > 0.01 THEN 'edge' WHEN texture > 3 THEN 'texture' ELSE 'normal' END"


def _textures(spark: SparkSession, d: str) -> DataFrame:
    plane = _images(spark, d).where(_good()).select("id", "edge_density", v.channel(F.col("g"), 0).alias("p"))
    plane = plane.select("*", v.pattern_codes(F.col("p")).alias("codes"))
    return plane.select("id", "edge_density", v.variance(F.col("p")).alias("l_variance"), v.pattern_entropy(F.col("codes")).alias("texture"), v.gradient_density(F.col("p")).alias("gradient"), F.aggregate("codes", F.lit(0), lambda s, c: s + c).alias("code_sum"))


@query(f"WITH {_TEX} SELECT id, round(l_variance, 4) AS l_variance, round(texture, 6) AS texture, round(gradient, 6) AS gradient, CAST(code_sum AS INT) AS code_sum, {_CAT.format('')} AS category, {_CAT.format(chr(87) + 'HEN edge_density < 0.005 THEN ' + chr(39) + 'normal' + chr(39))} AS report_category FROM t")
def grid_texture(spark, d):
    """Variance, pattern entropy, gradient density and category of every image's L plane."""
    t = _textures(spark, d)
    args = (F.col("edge_density"), F.col("l_variance"), F.col("texture"))
    return t.select("id", F.round("l_variance", 4).alias("l_variance"), F.round("texture", 6).alias("texture"), F.round("gradient", 6).alias("gradient"), "code_sum", v.category(*args).alias("category"), v.category(*args, report=True).alias("report_category"))


@query(f"WITH {_TEX}, k AS (SELECT {_CAT.format('')} AS category FROM t) SELECT k.category, count(*) AS n, w.lab, w.grid, w.tiny, w.edge, w.texture FROM k JOIN (VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}::double' for x in w)})" for k, w in v.CATEGORY_WEIGHTS.items()) + ") w(category, lab, grid, tiny, edge, texture) ON w.category = k.category GROUP BY ALL")
def match_category_weights(spark, d):
    """How many images fall in each category, and its feature weights."""
    kinds = _textures(spark, d).groupBy(v.category(F.col("edge_density"), F.col("l_variance"), F.col("texture")).alias("category")).agg(F.count("*").alias("n"))
    w = v.category_weights(F.col("category"))
    return kinds.select("category", "n", *[w[i].alias(n) for i, n in enumerate(("lab", "grid", "tiny", "edge", "texture"))])


@query(
    f"""WITH {_TEX}, u AS (SELECT 'edge' AS measure, edge_density AS x FROM t UNION ALL SELECT 'texture', texture FROM t),
s AS (SELECT measure, x, row_number() OVER (PARTITION BY measure ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY measure) AS n FROM u WHERE x IS NOT NULL)
SELECT measure, max(n) AS n, round(max(x) FILTER (r = n // 2), 6) AS median, round(max(x) FILTER (r = n * 9 // 10), 6) AS p90, round(max(x) FILTER (r = n * 95 // 100), 6) AS p95, round(max(x) FILTER (r = n * 99 // 100), 6) AS p99 FROM s GROUP BY measure"""
)
def adaptive_percentiles(spark, d):
    """Distribution of the two measures that choose the category."""
    t = _textures(spark, d)
    both = t.select(F.inline(F.array(F.struct(F.lit("edge").alias("measure"), F.col("edge_density").alias("x")), F.struct(F.lit("texture").alias("measure"), F.col("texture").alias("x")))))
    got = index_percentiles(cut(both), "measure", "x", ("median", "p90", "p95", "p99"))
    return rounded(got.select("measure", "n", "median", "p90", "p95", "p99"))


_HALF = "list_transform(range(48), lambda k: (g[((k//12)*16 + ((k//3)%4)*2)*3 + k%3 + 1] + g[((k//12)*16 + ((k//3)%4)*2)*3 + k%3 + 4] + g[((k//12)*16 + ((k//3)%4)*2)*3 + k%3 + 25] + g[((k//12)*16 + ((k//3)%4)*2)*3 + k%3 + 28]) / 4)"


@query(f"WITH {_IMG}, h AS MATERIALIZED (SELECT id, g, {_HALF} AS h FROM img WHERE {_GOOD}) SELECT id, round(h[1], 4) AS first, round(h[48], 4) AS last, round(list_sum(list_transform(range(48), lambda k: h[k+1] * (k+1))), 3) AS check_sum FROM h")
def grid_downsample(spark, d):
    h = _images(spark, d).where(_good()).select("id", v.halved(F.col("g")).alias("h"))
    check = v.total(F.transform("h", lambda x, i: x * (i + 1)))
    return h.select("id", F.round(F.col("h")[0], 4).alias("first"), F.round(F.col("h")[47], 4).alias("last"), F.round(check, 3).alias("check_sum"))


@query(
    f"""WITH {_IMG}, h AS MATERIALIZED (SELECT id, {_HALF} AS h FROM img WHERE {_GOOD}),
u AS MATERIALIZED (SELECT id, list_transform(range(192), lambda k: h[((k//48)*4 + ((k//3)%8)//2)*3 + k%3 + 1]) AS u FROM h)
SELECT id, len(u) AS n, round(u[7], 4) AS seventh, round(list_sum(list_transform(range(192), lambda k: u[k+1] * (k+1))), 3) AS check_sum FROM u"""
)
def grid_upsample(spark, d):
    u = _images(spark, d).where(_good()).select("id", v.doubled(v.halved(F.col("g"))).alias("u"))
    check = v.total(F.transform("u", lambda x, i: x * (i + 1)))
    return u.select("id", F.size("u").cast("bigint").alias("n"), F.round(F.col("u")[6], 4).alias("seventh"), F.round(check, 3).alias("check_sum"))


@query(
    f"""WITH {_TEX}, hist AS MATERIALIZED (SELECT id, codes, list_transform(range(256), lambda b: len(list_filter(codes, lambda q: q = b)) / 36.0::double) AS h FROM codes)
SELECT id, round(list_sum(h), 6) AS whole, round(h[256], 6) AS all_bright, round(h[1], 6) AS all_dark, round(list_sum(list_transform(h, lambda v: abs(v - 1.0 / 256))) / 2, 6) AS from_flat FROM hist"""
)
def pattern_histogram(spark, d):
    """256-bin pattern histogram of every L plane, and its distance from a flat one."""
    plane = _images(spark, d).where(_good()).select("id", v.pattern_histogram(v.pattern_codes(v.channel(F.col("g"), 0))).alias("h"))
    flat = F.array_repeat(F.lit(1 / 256), 256)
    made = v.let(F.col("h"), lambda h: F.struct(v.total(h).alias("whole"), h[255].alias("all_bright"), h[0].alias("all_dark"), v.histogram_distance(h, flat).alias("from_flat")))
    return rounded(plane.select("id", made.alias("m")).select("id", "m.*"))


@query(f"WITH {_IMG}, p AS (SELECT id, {_PLANE} AS p FROM img WHERE {_GOOD}) SELECT id, round(list_sum(list_transform(p, lambda v: (v - 128)**2)) / (64 * 65025.0), 6) AS tiny FROM p")
def tiny_mse(spark, d):
    """Error of every L plane, enlarged to 16x16, against mid grey."""
    plane = _images(spark, d).where(_good()).select("id", v.channel(F.col("g"), 0).alias("p"))
    tiny = v.let(F.col("p"), lambda p: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: p[(F.floor(i / 32) * 8 + F.floor((i % 16) / 2)).cast("int")]))
    return rounded(plane.select("id", v.tiny_error(tiny, F.array_repeat(F.lit(128.0), 256)).alias("tiny")))


# --- two-stage matching --------------------------------------------------------------------------------------------------

_VEC = "list_concat([avg_l / 255, avg_a / 255, avg_b / 255], list_transform(g, lambda x: x / 255), [edge_density])"
_MATCH = f"""{_IMG}, lib AS MATERIALIZED (SELECT *, {_VEC} AS v FROM img WHERE {_GOOD} AND avg_l IS NOT NULL AND avg_a IS NOT NULL AND avg_b IS NOT NULL AND edge_density IS NOT NULL),
t AS (SELECT p.probe_no AS tile, l.* FROM knn_probes p JOIN lib l ON l.id = p.image_id),
near AS (SELECT t.tile, l.id AS image_id, row_number() OVER (PARTITION BY t.tile ORDER BY list_distance(t.v, l.v), l.id) AS ann_rank FROM t JOIN lib l ON l.id <> t.id),
c AS MATERIALIZED (SELECT n.tile, n.image_id, n.ann_rank, l.use_count, sqrt((t.avg_l - l.avg_l)**2 + (t.avg_a - l.avg_a)**2 + (t.avg_b - l.avg_b)**2) / 100 AS lab, abs(t.edge_density - l.edge_density) AS edge, t.g AS g, l.g AS yg
  FROM near n JOIN t ON t.tile = n.tile JOIN lib l ON l.id = n.image_id WHERE n.ann_rank <= {CANDIDATES}),
w AS MATERIALIZED (SELECT *, list_sum(list_transform(range(64), lambda i: sqrt({_terms(_SQ)}) * {_W}[i+1])) / 6400 AS grid FROM c),
s AS (SELECT tile, image_id, ann_rank, (0.20 * lab + 0.45 * grid + 0.05 * edge) / 0.70 + coalesce(use_count, 0) * 0.01 AS score, lab, grid, edge, g, yg FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY score, image_id) AS rank, lead(score) OVER (PARTITION BY tile ORDER BY score, image_id) - score AS gap FROM s)"""


def _featured(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).where(_good() & F.col("avg_l").isNotNull() & F.col("avg_a").isNotNull() & F.col("avg_b").isNotNull() & F.col("edge_density").isNotNull())


def _library(spark: SparkSession, d: str) -> DataFrame:
    lib = _featured(spark, d)
    vec = F.concat(F.array(F.col("avg_l") / 255, F.col("avg_a") / 255, F.col("avg_b") / 255), F.transform("g", lambda x: x.cast("double") / 255), F.array("edge_density"))
    return cut(lib.withColumn("vec", vec))


def _scored(lib: DataFrame, tiles: DataFrame) -> DataFrame:
    """tiles (tile, t_id, features) with their nearest library rows, distances and scores."""
    near = nearest.knn(lib.select("id", "vec"), tiles.groupBy("t_id").agg(F.first("vec").alias("vec")).select(F.col("t_id").alias("q"), "vec"), CANDIDATES)
    pairs = near.select(F.col("q").alias("t_id"), "id", F.col("rank").alias("ann_rank")).join(tiles.select("tile", "t_id"), "t_id").select("tile", "id", "ann_rank")
    return selector.scored_pairs(lib, tiles, pairs, WEIGHTS, USE_PENALTY).withColumnRenamed("id", "image_id")


def _probe_tiles(spark: SparkSession, d: str, lib: DataFrame) -> DataFrame:
    return cut(table(spark, d, "knn_probes").select(F.col("probe_no").alias("tile"), F.col("image_id").alias("t_id")).join(lib.withColumnRenamed("id", "t_id"), "t_id"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Tiles (the probes' images) with their nearest library rows, both rows' features, and the score."""
    lib = _library(spark, d)
    tiles = _probe_tiles(spark, d, lib)
    both = _scored(lib, tiles).join(lib.select(F.col("id").alias("image_id"), "g"), "image_id")
    return both.join(tiles.select("tile", F.col("g").alias("t_g"), F.col("avg_l").alias("t_avg_l")), "tile")


@query(f"WITH {_MATCH} SELECT tile, image_id, CAST(ann_rank AS INT) AS ann_rank, CAST(rank AS INT) AS rank, round(score, 6) AS score, round(gap, 6) AS gap FROM r WHERE rank <= {K}")
def rerank_two_stage(spark, d):
    lib = _library(spark, d)
    got = selector.ranked_candidates(_scored(lib, _probe_tiles(spark, d, lib))).where(F.col("rank") <= K)
    return rounded(got.select("tile", "image_id", "ann_rank", "rank", "score", "gap"))


@query()
def rerank_used_images(spark, d):
    """The best of its nearest rows for every image that a winner names: the two stages at the size of a whole target."""
    lib = cut(_featured(spark, d).drop("file_hash"))
    used = table(spark, d, "winners").where("image_id > 0").select(F.col("image_id").alias("id")).distinct()
    tiles = cut(used.join(lib, "id").withColumn("tile", F.col("id")))
    return rounded(selector.best_of_nearest(lib, tiles, CANDIDATES, WEIGHTS, USE_PENALTY))


@query(
    f"""WITH {_MATCH.split("near AS")[0]}c AS MATERIALIZED (SELECT t.tile, l.id AS image_id, l.use_count, sqrt((t.avg_l - l.avg_l)**2 + (t.avg_a - l.avg_a)**2 + (t.avg_b - l.avg_b)**2) / 100 AS lab, abs(t.edge_density - l.edge_density) AS edge, t.g AS g, l.g AS yg FROM t JOIN lib l ON l.id <> t.id),
s AS (SELECT tile, image_id, (0.20 * lab + 0.45 * list_sum(list_transform(range(64), lambda i: sqrt({_terms(_SQ)}) * {_W}[i+1])) / 6400 + 0.05 * edge) / 0.70 + coalesce(use_count, 0) * 0.01 AS score FROM c)
SELECT tile, image_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY score, image_id) AS r FROM s) WHERE r = 1"""
)
def best_match(spark, d):
    """The single best row of the whole library for every tile."""
    lib = _library(spark, d).drop("vec", "file_hash")
    tiles = table(spark, d, "knn_probes").select(F.col("probe_no").alias("tile"), F.col("image_id").alias("id")).join(lib, "id")
    return rounded(selector.full_match(lib, tiles, WEIGHTS, USE_PENALTY))


@query(f"WITH {_MATCH} SELECT round(sum(0.20 * lab) / sum(0.20 * lab + 0.45 * grid + 0.05 * edge), 6) AS lab, round(sum(0.45 * grid) / sum(0.20 * lab + 0.45 * grid + 0.05 * edge), 6) AS grid, round(sum(0.05 * edge) / sum(0.20 * lab + 0.45 * grid + 0.05 * edge), 6) AS edge FROM r WHERE rank = 1")
def feature_contribution(spark, d):
    """Each feature's share of the winners' weighted distance."""
    best = _candidates(spark, d).groupBy("tile").agg(F.min(F.struct("score", "image_id", "lab", "grid", "edge")).alias("m")).select("m.*")
    whole = sum((F.sum(F.col(k) * w) for k, w in WEIGHTS.items()), F.lit(0.0))
    return rounded(best.agg(*[F.try_divide(F.sum(F.col(k) * w), whole).alias(k) for k, w in WEIGHTS.items()]))


_H = "(list_sum(list_transform(range(16), lambda k: sqrt((x[3*k+1] - y[3*k+1])**2 + (x[3*k+2] - y[3*k+2])**2 + (x[3*k+3] - y[3*k+3])**2))) / 1600)"


@query(
    f"""WITH {_MATCH}, h AS MATERIALIZED (SELECT tile, image_id, {_HALF} AS x, {_HALF.replace('g[', 'yg[')} AS y, list_sum(list_transform(range(64), lambda i: sqrt({_terms(_SQ)}))) / 6400 AS fine FROM s),
b AS (SELECT tile, arg_min(image_id, row(round(fine, 9), image_id)) AS f, arg_min(image_id, row(round({_H}, 9), image_id)) AS c FROM h GROUP BY tile)
SELECT count(*) AS tiles, round(avg(CASE WHEN f <> c THEN 1.0::double ELSE 0 END), 6) AS differ FROM b"""
)
def grid_size_experiment(spark, d):
    """How often the nearest candidate by 4x4 grids differs from that by 8x8 grids."""
    c = _candidates(spark, d).select("tile", "image_id", v.plain_grid_distance(F.col("t_g"), F.col("g")).alias("fine"), v.plain_grid_distance(v.halved(F.col("t_g")), v.halved(F.col("g"))).alias("coarse"))
    best = c.groupBy("tile").agg(F.min(F.struct(F.round("fine", 9).alias("a"), "image_id")).alias("f"), F.min(F.struct(F.round("coarse", 9).alias("a"), "image_id")).alias("c"))
    return rounded(best.agg(F.count("*").alias("tiles"), F.avg((F.col("f.image_id") != F.col("c.image_id")).cast("double")).alias("differ")))


@query(
    f"""WITH {_MATCH}, m AS (SELECT r.lab, r.grid, l.use_count, t.avg_l FROM r JOIN t ON t.tile = r.tile JOIN lib l ON l.id = r.image_id WHERE r.rank = 1)
SELECT CASE WHEN lab > 0.3 THEN 'colour' WHEN grid > 0.5 THEN 'layout' WHEN avg_l < 60 THEN 'dark' WHEN use_count > 10 THEN 'popular' ELSE 'combined' END AS cause, count(*) AS tiles FROM m GROUP BY 1"""
)
def worst_causes(spark, d):
    """Why the winners fit as badly as they do."""
    best = _candidates(spark, d).groupBy("tile").agg(F.min(F.struct("score", "image_id", "lab", "grid", "t_avg_l", "use_count")).alias("m")).select("m.*")
    return best.groupBy(analysis.worst_cause(F.col("lab"), F.col("grid"), F.col("t_avg_l"), F.col("use_count")).alias("cause")).agg(F.count("*").alias("tiles"))


@query()
def greedy_select(spark, d):
    """Winners of four runs over the probes' tiles, one after the other in each run."""
    c = _candidates(spark, d).select((F.col("tile") % 4).alias("run_id"), "tile", "image_id", "score", "g").withColumnRenamed("g", "grid")
    return rounded(selector.greedy_choice(c, selector.auto_window(10, table(spark, d, "images").count()), tiles_x=10))
