"""Library analytics: statistics, histograms, health, usage, and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.content import hash_value

# The limits of the brightness bands and of the warnings, and their texts.
STATS_BANDS = (30, 70)
HEALTH_BANDS = (50, 150)
GAP_TEXTS = {"dark_mid": "few dark and medium images", "min_a": "no strong green", "max_a": "no strong red", "min_b": "no strong blue", "max_b": "no strong yellow"}


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(100.0 * part, whole)


def band_counts(bands: tuple[int, int], l: str = "avg_l") -> list[Column]:
    lo, hi = bands
    return [
        F.count_if(F.col(l) < lo).alias("dark"),
        F.count_if((F.col(l) >= lo) & (F.col(l) < hi)).alias("mid"),
        F.count_if(F.col(l) >= hi).alias("bright"),
    ]


def _ranges() -> list[Column]:
    made = []
    for c in ("l", "a", "b"):
        made += [F.min(f"avg_{c}").alias(f"min_{c}"), F.max(f"avg_{c}").alias(f"max_{c}"), F.avg(f"avg_{c}").alias(f"mean_{c}")]
    return made


def library_stats(images: DataFrame) -> DataFrame:
    """One row: count, range and mean of L, A, B, and the counts of the three brightness bands (null L is in none)."""
    return images.agg(F.count("*").alias("total"), *_ranges(), *band_counts(STATS_BANDS))


def l_histogram(images: DataFrame, bins: int = 8, top: int = 256) -> DataFrame:
    """(bin, label, n) of every bin, also empty ones; values outside go to the outer bins, nulls to none."""
    width = top // bins
    got = images.where("avg_l IS NOT NULL").groupBy(F.least(F.greatest(F.floor(F.col("avg_l") / width), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_bins = images.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    label = F.concat(F.col("bin") * width, F.lit("-"), (F.col("bin") + 1) * width - 1)
    return all_bins.join(got, "bin", "left").select("bin", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def coverage_gaps(images: DataFrame) -> DataFrame:
    """(rule, message) of every rule the library breaks; an empty library breaks none but the first's strict bound."""
    s = library_stats(images)
    rules = F.array(
        *[
            F.when(test, F.struct(F.lit(name).alias("rule"), F.lit(GAP_TEXTS[name]).alias("message")))
            for name, test in (
                ("dark_mid", F.col("dark") + F.col("mid") < F.floor(F.col("total") / 100)),
                ("min_a", F.col("min_a") > 110), ("max_a", F.col("max_a") < 145), ("min_b", F.col("min_b") > 110), ("max_b", F.col("max_b") < 145),
            )
        ]
    )
    return s.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("r.rule", "r.message")


def hotspot_share(usage: DataFrame) -> DataFrame:
    """One row (used, top, hotspot_tiles, all_tiles, hotspot_pct): tiles of the hundredth of images with most runs.

    The top images are a bounded take in the order of runs, then id; a hundredth of the used images is not a constant, so
    their rank comes from one global order, computed by range partitions.
    """
    from gridloom.operators.ranking import spread_rank

    ranked = spread_rank(usage.select(F.lit(0).alias("g"), "image_id", "total_runs", "total_tiles", F.xxhash64("image_id", "total_runs", "total_tiles", "last_used").alias("h")), ["g"], [F.col("total_runs").desc_nulls_last(), F.col("image_id"), F.col("total_tiles").desc(), F.col("h")], "r")
    used = usage.agg(F.count("*").alias("used")).withColumn("top", F.greatest(F.floor(F.col("used") / 100), F.lit(1)))
    sums = ranked.crossJoin(F.broadcast(used)).agg(F.max("used").alias("used"), F.max("top").alias("top"), F.sum(F.when(F.col("r") <= F.col("top"), F.col("total_tiles"))).alias("hotspot_tiles"), F.sum("total_tiles").alias("all_tiles"))
    return sums.withColumn("hotspot_pct", _share(F.col("hotspot_tiles"), F.col("all_tiles")))


#: Recommendations by rule: what to add to, or do with, a library.
ADVICE = {"dark": "add dark pictures", "mid": "add pictures of medium light", "green_red": "widen the green to red range", "blue_yellow": "widen the blue to yellow range", "unused": "look at the usage list"}


def library_usage(images: DataFrame, usage: DataFrame) -> DataFrame:
    """One usage row per library image in use: replays merged, ids the library lacks left out."""
    return merged_usage(usage).join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")


def health_report(images: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: bands, gamut, used and unused images with percentages, warnings as flags, and the rules (keys of ADVICE, joined
    by commas) that call for a recommendation. Used images are those of the library with a usage row, replays counted once.
    An empty library has null shares and no warnings."""
    base = images.agg(F.count("*").alias("total"), *band_counts(HEALTH_BANDS), F.min("avg_a").alias("min_a"), F.max("avg_a").alias("max_a"), F.min("avg_b").alias("min_b"), F.max("avg_b").alias("max_b"))
    hot = hotspot_share(library_usage(images, usage)).select(F.coalesce("used", F.lit(0)).alias("used"), "hotspot_pct")
    row = base.crossJoin(F.broadcast(hot)).withColumn("unused", F.col("total") - F.col("used"))
    for part in ("dark", "mid", "bright", "used", "unused"):
        row = row.withColumn(f"{part}_pct", _share(F.col(part), F.col("total")))
    flags = {
        "dark": F.col("dark_pct") < 5, "mid": F.col("mid_pct") < 15, "min_a": F.col("min_a") > 115, "max_a": F.col("max_a") < 140,
        "min_b": F.col("min_b") > 115, "max_b": F.col("max_b") < 140, "unused": F.col("unused") > F.floor(F.col("total") / 2), "hotspot": F.col("hotspot_pct") > 20,
    }
    advice = {"dark": flags["dark"], "mid": flags["mid"], "green_red": flags["min_a"] | flags["max_a"], "blue_yellow": flags["min_b"] | flags["max_b"], "unused": flags["unused"]}
    kept = ["total", "dark", "mid", "bright", "dark_pct", "mid_pct", "bright_pct", "min_a", "max_a", "min_b", "max_b", "used", "unused", "used_pct", "unused_pct", "hotspot_pct"]
    return row.select(*kept, *[t.alias(f"warn_{k}") for k, t in flags.items()], F.concat_ws(",", *[F.when(t, F.lit(k)) for k, t in advice.items()]).alias("advice"))


def l_range(images: DataFrame, low: float, high: float, limit: int | None = None) -> DataFrame:
    """Rows whose avg_l is in [low, high], least used first if limited (null counts last)."""
    hit = images.where(F.col("avg_l").between(low, high))
    return hit.orderBy(F.col("use_count").asc_nulls_last(), "id").limit(limit) if limit else hit


def top_used(usage: DataFrame, n: int) -> DataFrame:
    return usage.orderBy(F.col("total_runs").desc_nulls_last(), F.col("total_tiles").desc_nulls_last(), F.col("image_id"), F.col("last_used")).limit(n)


def merged_usage(usage: DataFrame) -> DataFrame:
    """One row per image of replayed usage rows: the most advanced row wins (tiles, then runs, then time)."""
    best = F.struct("total_tiles", "total_runs", "last_used")
    return usage.where("image_id > 0").groupBy("image_id").agg(F.max(best).alias("b")).select("image_id", "b.total_runs", "b.total_tiles", "b.last_used")


def usage_export(usage: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, rank, file_name, found): used images by tiles, named for export; ids the library lacks have found = false."""
    from gridloom.operators.ranking import spread_rank

    one = merged_usage(usage).join(images.select(F.col("id").alias("image_id"), "file_path"), "image_id", "left")
    one = one.select(F.lit(0).alias("g"), "image_id", "total_runs", "total_tiles", "file_path")
    ranked = spread_rank(one, ["g"], [F.col("total_tiles").desc_nulls_last(), F.col("image_id")])
    ext = F.coalesce(F.regexp_extract("file_path", r"(\.[^./\\]+)$", 1), F.lit(""))
    name = F.concat(F.format_string("rank%04d_", "rank"), F.col("total_runs"), F.lit("runs_"), F.col("total_tiles"), F.lit("tiles_id"), F.col("image_id"), ext)
    return ranked.select("image_id", "rank", name.alias("file_name"), F.col("file_path").isNotNull().alias("found"))


def unused_images(images: DataFrame, usage: DataFrame) -> DataFrame:
    return images.join(usage.select(F.col("image_id").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti").select("id", "file_path")


def first_of_content(rows: DataFrame, key: str | Column, order: list[str]) -> DataFrame:
    """The first row of every content by the order columns (ascending); rows without a content key all stay."""
    keyed = rows.withColumn("_content", F.col(key) if isinstance(key, str) else key)
    first = keyed.where("_content IS NOT NULL").groupBy("_content").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
    return first.unionByName(keyed.where("_content IS NULL").select(*rows.columns))


def known_hashes(rows: DataFrame, library: DataFrame) -> DataFrame:
    """The rows whose file_hash denotes a value that a library row's denotes, whatever the notation; void hashes are not known."""
    old = library.select(hash_value(F.col("file_hash")).alias("_hash")).distinct()
    return rows.withColumn("_hash", hash_value(F.col("file_hash"))).join(old, "_hash", "left_semi").drop("_hash")


def append_build(library: DataFrame, fresh: DataFrame) -> DataFrame:
    """(file_hash, file_path, known): an incremental build. Library rows stay; of the fresh rows the first of each hash value
    comes in if neither its value nor its path is there yet. Hashes that denote no value are compared by path only."""
    old = library.select("file_hash", "file_path")
    new = first_of_content(fresh.select("file_hash", "file_path").distinct(), hash_value(F.col("file_hash")), ["file_path", "file_hash"])
    new = first_of_content(new, "file_path", ["file_hash"]).withColumn("_hash", hash_value(F.col("file_hash")))
    held = old.select(hash_value(F.col("file_hash")).alias("_hash")).where("_hash IS NOT NULL").distinct()
    new = new.join(held, "_hash", "left_anti").join(old.select("file_path").distinct(), "file_path", "left_anti")
    return old.withColumn("known", F.lit(True)).unionByName(new.select("file_hash", "file_path").withColumn("known", F.lit(False)))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the rows of changes in place of those of equal key; the last of several changes, by all columns, wins."""
    change = changes.groupBy(key).agg(F.max(F.struct(*[c for c in changes.columns if c != key])).alias("c")).select(key, "c.*")
    return table.join(change.select(key), key, "left_anti").unionByName(change.select(*table.columns))


def recorded_usage(usage: DataFrame, winners: DataFrame, runs: DataFrame) -> DataFrame:
    """(image_id, total_runs, total_tiles): usage after recording winners. Tiles always add up; a run counts for an image only
    if its target was never seen in runs, once per target."""
    seen = runs.select("target_hash").where("target_hash IS NOT NULL").distinct().withColumn("seen", F.lit(True))
    used = winners.where("image_id > 0").groupBy("image_id", "target_hash").agg(F.count("*").alias("tiles"))
    used = used.join(seen, "target_hash", "left").groupBy("image_id").agg(F.count_if(F.col("seen").isNull() & F.col("target_hash").isNotNull()).alias("total_runs"), F.sum("tiles").alias("total_tiles"))
    old = merged_usage(usage).select("image_id", F.col("total_runs").cast("bigint"), "total_tiles")
    return old.unionByName(used).groupBy("image_id").agg(F.sum("total_runs").alias("total_runs"), F.sum("total_tiles").alias("total_tiles"))


def band_join(queries: DataFrame, images: DataFrame, reach: int = 20) -> DataFrame:
    """(q, n, dark, mid, bright, min_l, max_l, mean_l) of the library rows within +-reach of each query's L.

    A band join would meet every pair; here both sides are cut into bands as wide as the reach. A query meets only its own
    and the two next bands, and those two summed to one row per distinct L where possible.
    """
    steps = images.where("avg_l IS NOT NULL").groupBy("avg_l").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.col("avg_l") / reach))
    asked = queries.where("l IS NOT NULL").select("q", "l", F.explode(F.array(*[F.floor(F.col("l") / reach) + i for i in (-1, 0, 1)])).alias("band"))
    near = asked.join(steps, "band").where(F.abs(F.col("avg_l") - F.col("l")) <= reach)
    n = F.col("n")
    return near.groupBy("q").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("avg_l") < 30, n).otherwise(0)).alias("dark"), F.sum(F.when((F.col("avg_l") >= 30) & (F.col("avg_l") < 70), n).otherwise(0)).alias("mid"),
        F.sum(F.when(F.col("avg_l") >= 70, n).otherwise(0)).alias("bright"), F.min("avg_l").alias("min_l"), F.max("avg_l").alias("max_l"), (F.sum(F.col("avg_l") * n) / F.sum("n")).alias("mean_l"),
    )
