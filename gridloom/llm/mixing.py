"""Mixing sources to target weights: systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranking import spread_rank


def _plan(sized: DataFrame, targets: DataFrame, total: float | None) -> DataFrame:
    """One row per target source: its tokens, share of what is reachable, and expected copies of each document."""
    have = sized.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("has_tokens"), F.count("*").alias("has_docs"))
    want = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = want.join(have, "source", "left").fillna(0, ["has_tokens", "has_docs"])
    sums = plan.agg(F.sum(F.when(F.col("has_tokens") > 0, F.col("target_share"))).alias("reachable"))
    plan = plan.crossJoin(F.broadcast(sums)).withColumn("share", F.when(F.col("has_tokens") > 0, F.col("target_share") / F.col("reachable")))
    most = plan.agg(F.min(F.col("max_repeats") * F.col("has_tokens") / F.col("share")).alias("most"))
    goal = F.col("most") if total is None else F.least(F.col("most"), F.lit(float(total)))
    return plan.crossJoin(F.broadcast(most)).withColumn("expected", F.least(goal * F.col("share") / F.col("has_tokens"), F.col("max_repeats").cast("double"))).drop("most", "reachable")


def mixture(sized: DataFrame, targets: DataFrame, key: str = "doc_id", total: float | None = None, seed: int = 7) -> DataFrame:
    """(key, source, n_tokens, copies): the documents of a mixture in which every source has its target share of tokens.

    sized: (key, source, n_tokens); targets: (source, target_share, max_repeats). The mixture has `total` tokens, or as many
    as the caps allow: the largest size at which no source needs a document more than max_repeats times. Shares of sources
    without tokens go to the others in proportion. Within a source documents are laid out by size, each as long as its
    expected copies; one random offset per source is added, and a copy comes out for each whole number crossed, so counts
    never stray from the expectation by one and all sizes are drawn evenly. Documents of other sources, of a null source,
    or without tokens are left out. Ranks within a source come from range slices, so a source may hold any share of rows;
    the plan has a row per target source and is broadcast after it is seen to be no larger than the target table.
    """
    plan = _plan(sized, targets, total).where("expected > 0").select("source", "expected")
    used = sized.where("n_tokens > 0").select(F.col(key).alias("_key"), "source", "n_tokens", F.xxhash64(F.lit(seed), F.col(key)).alias("_h"))
    used = used.join(F.broadcast(plan.select("source")), "source", "left_semi")
    ranked = spread_rank(used, ["source"], [F.col("n_tokens"), F.col("_h"), F.col("_key")], "_rank").join(F.broadcast(plan), "source")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("_rank") * F.col("expected") + offset) - F.floor((F.col("_rank") - 1) * F.col("expected") + offset)
    return ranked.select(F.col("_key").alias(key), "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def mixture_shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, most_copies, tokens, actual_share) of every target source, also those without documents."""
    got = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    want = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = want.join(got, "source", "left").fillna(0, ["docs", "most_copies", "tokens"])
    all_tokens = both.agg(F.sum("tokens").alias("all_tokens"))
    return both.crossJoin(F.broadcast(all_tokens)).select("source", "target_share", "max_repeats", "docs", "most_copies", "tokens", F.try_divide("tokens", "all_tokens").alias("actual_share"))


def mixture_limits(shares: DataFrame, sized: DataFrame) -> DataFrame:
    """(source, capped, on_target) of mixture_shares' rows: no document is used more often than allowed, and the tokens are within
    two of the largest documents of the target's part of what is reachable; sources without documents have nothing."""
    sums = shares.agg(F.sum(F.when(F.col("docs") > 0, F.col("target_share"))).alias("reachable"), F.sum("tokens").alias("all_tokens"))
    most = sized.agg(F.max("n_tokens").alias("largest"))
    wanted = F.when(F.col("docs") > 0, F.col("target_share") / F.col("reachable") * F.col("all_tokens")).otherwise(F.lit(0.0))
    both = shares.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(most))
    return both.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), (F.abs(F.col("tokens") - wanted) <= 2 * F.col("largest")).alias("on_target"))
