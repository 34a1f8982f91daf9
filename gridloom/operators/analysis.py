"""Match-quality analytics over chosen images (winners)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranking import spread_rank

#: Numerators and denominators of the index percentiles: value number n * p div q of the sorted values, from 0.
PERCENTILES = {"median": (1, 2), "p90": (9, 10), "p95": (95, 100), "p99": (99, 100)}


def index_percentiles(rows: DataFrame, group: str, value: str, names: tuple[str, ...] = ("median", "p90", "p99")) -> DataFrame:
    """(group, n, mean, least, most, and the named percentiles): no interpolation, value number n * p div q counted from 0.

    Equal values are summed before anything is sorted, and running counts over the distinct values find the percentiles,
    so a group with a third of all rows shuffles no more rows than it has distinct values per task. Null values are left out.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    order = spread_rank(counted, [group], [F.col(value)], "_r")
    sums = counted.groupBy(group).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    # Running counts: a slice of SLICE ranks at a time, plus the slices before it.
    piece = F.floor(F.col("_r") / 65536)
    order = order.withColumn("_s", piece)
    before = order.groupBy(group, "_s").agg(F.sum("c").alias("_c"))
    before = before.select(F.col(group).alias("_g"), F.col("_s").alias("_t"), F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    upto = F.sum("c").over(Window.partitionBy(group, "_s").orderBy("_r"))
    cum = order.withColumn("_u", upto).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t"))).withColumn("_u", F.col("_u") + F.col("_b"))
    with_n = cum.select(F.col(group).alias("_k"), F.col(value).alias("_v"), "c", "_u").join(sums.select(F.col(group).alias("_k2"), F.col("n").alias("_n")), F.col("_k").eqNullSafe(F.col("_k2")))
    picks = []
    for name in names:
        p, q = PERCENTILES[name]
        at = F.floor(F.col("_n") * p / q)
        picks.append(F.max(F.when((F.col("_u") > at) & (F.col("_u") - F.col("c") <= at), F.col("_v"))).alias(name))
    chosen = with_n.groupBy("_k").agg(*picks)
    return sums.join(chosen, F.col(group).eqNullSafe(F.col("_k"))).drop("_k")


def rank_buckets(winners: DataFrame) -> DataFrame:
    """(bucket, n): winners by their rank among the candidates: 1, 2, 3 or more; ranks count from 0 in the table."""
    return winners.where("cand_rank >= 0").groupBy(F.least(F.col("cand_rank") + 1, F.lit(4)).alias("bucket")).agg(F.count("*").alias("n"))


def recall_at(winners: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20, 50)) -> DataFrame:
    """(k, share): winners that were among the first k candidates."""
    sums = winners.where("cand_rank >= 0").agg(F.count("*").alias("n"), *[F.count_if(F.col("cand_rank") < k).alias(f"k{k}") for k in ks])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.try_divide(F.col(f"k{k}").cast("double"), F.col("n")).alias("share")) for k in ks])))


def category_scores(winners: DataFrame) -> DataFrame:
    return winners.groupBy("category").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def reuse(winners: DataFrame) -> DataFrame:
    """One row (tiles, images, per_image, top10): how often images are used again; top10 is the share of the ten most used."""
    counts = winners.where("image_id > 0").groupBy("image_id").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.desc("image_id")).limit(10).agg(F.sum("n").alias("top_tiles"))
    sums = counts.agg(F.sum("n").alias("tiles"), F.count("*").alias("images"))
    return sums.crossJoin(F.broadcast(top)).select("tiles", "images", F.try_divide(F.col("tiles").cast("double"), F.col("images")).alias("per_image"), F.try_divide(F.col("top_tiles").cast("double"), F.col("tiles")).alias("top10"))


def use_class(n: Column) -> Column:
    return F.when(n <= 3, n.cast("string")).when(n <= 5, F.lit("4-5")).when(n <= 10, F.lit("6-10")).otherwise(F.lit(">10"))


def use_frequencies(winners: DataFrame) -> DataFrame:
    """(uses, images, tiles): how many images were used once, twice, ..."""
    counts = winners.where("image_id > 0").groupBy("image_id").agg(F.count("*").alias("n"))
    return counts.groupBy(use_class(F.col("n")).alias("uses")).agg(F.count("*").alias("images"), F.sum("n").alias("tiles"))


def score_histogram(winners: DataFrame, bins: int = 10, scale: float = 30.0) -> DataFrame:
    at = F.least(F.greatest(F.floor(F.col("score") * scale), F.lit(0)), F.lit(bins - 1)).cast("int")
    got = winners.where("score IS NOT NULL").groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return winners.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def worst_tiles(winners: DataFrame, n: int) -> DataFrame:
    """The n winners of highest score (then tile, run and image): the report's list."""
    return winners.select("run_id", "tile_idx", "image_id", "score").distinct().orderBy(F.desc_nulls_last("score"), F.desc("tile_idx"), F.desc("run_id"), F.desc_nulls_last("image_id")).limit(n)


# Beyond these a colour or layout distance explains a bad match, below this a tile is dark, above this an image popular.
FAR_COLOUR, FAR_LAYOUT, DARK_TILE, POPULAR = 0.3, 0.5, 60, 10


def worst_cause(lab: Column, grid: Column, tile_l: Column, uses: Column) -> Column:
    """Why a match is bad: colour, then layout, then a dark tile, then a popular image, else all together. Nulls explain nothing."""
    return F.when(lab > FAR_COLOUR, "colour").when(grid > FAR_LAYOUT, "layout").when(tile_l < DARK_TILE, "dark").when(uses > POPULAR, "popular").otherwise("combined")


def reuse_windows(winners: DataFrame, window: int) -> DataFrame:
    """(run_id, tile_idx, image_id, recent, gap): uses of the same image in the window tiles before, and tiles since its last use.

    Partitions are a run's uses of one image, sorted; a hot image's runs spread over tasks. Repeated rows count once, rows
    without tile or image not at all.
    """
    rows = winners.where("image_id > 0 AND tile_idx IS NOT NULL").select("run_id", "tile_idx", "image_id").distinct()
    w = Window.partitionBy("run_id", "image_id").orderBy("tile_idx")
    recent = F.count("*").over(w.rangeBetween(-window, -1))
    return rows.select("run_id", "tile_idx", "image_id", recent.alias("recent"), (F.col("tile_idx") - F.lag("tile_idx").over(w)).alias("gap"))


def heatmap(winners: DataFrame) -> DataFrame:
    """(run_id, tile_idx, heat, colour): scores scaled to 0..1 in their run; green, yellow and red thirds. Equal scores give 0.

    A run's ends are an aggregate joined back, so no window holds a run.
    """
    rows = winners.where("score IS NOT NULL AND tile_idx IS NOT NULL").groupBy("run_id", "tile_idx").agg(F.max("score").alias("score"))
    ends = rows.groupBy("run_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    heat = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return rows.join(ends, "run_id").select("run_id", "tile_idx", heat.alias("heat")).withColumn("colour", F.when(F.col("heat") < 1 / 3, "green").when(F.col("heat") < 2 / 3, "yellow").otherwise("red"))


def heat_ramp(heats: DataFrame) -> DataFrame:
    """(run_id, tile_idx, b, g, r): the report's colours as the score grows: red to green in the first half, yellow to red in the second."""
    t = F.col("heat")
    level = lambda share: F.floor(255 * share).cast("int")
    g = F.when(t < 0.5, level(t * 2)).otherwise(level(1 - (t - 0.5) * 2))
    return heats.select("run_id", "tile_idx", F.lit(0).alias("b"), g.alias("g"), F.when(t < 0.5, level(1 - t * 2)).otherwise(F.lit(255)).alias("r"))


def match_counters(winners: DataFrame, images: DataFrame) -> DataFrame:
    """One row: tiles, matched, without candidate (null or non-positive id), and pointing to images the library lacks."""
    per = winners.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("gap").isNull().cast("bigint")).alias("no_gap"))
    known = per.join(images.select(F.col("id").alias("image_id"), F.lit(1).alias("known")), "image_id", "left")
    n = F.col("n")
    return known.agg(
        F.sum("n").alias("tiles"), F.sum(F.when(F.col("known") == 1, n).otherwise(0)).alias("matched"), F.sum(F.when(F.coalesce(F.col("image_id"), F.lit(0)) <= 0, n).otherwise(0)).alias("no_candidate"),
        F.sum(F.when((F.col("image_id") > 0) & F.col("known").isNull(), n).otherwise(0)).alias("load_fail"), F.sum("no_gap").alias("no_gap"),
    )
