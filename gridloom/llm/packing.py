"""Filling fixed-capacity containers with items: vector best-fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items packed together by one task. Random shards of this size each leave at most a few bins part full.
SHARD = 8192
#: Share of the attention cost of one full item that a pack may reach. At 1 the token limit alone would decide.
COST_SHARE = 0.8
#: Repeated rows written out by one task at a time.
RUN = 65_536


def best_fit(sizes: np.ndarray, caps: np.ndarray, weights: np.ndarray, score: str = "residual") -> np.ndarray:
    """Bin number of each item. sizes: items x dimensions, each within caps; all constraints hold in every bin.

    Items go by falling size in the first dimension. Of the open bins an item fits in every dimension, the one is taken
    with the least weighted norm of what would be left ("residual"), or the largest weighted dot product of item and
    residual ("dot"); equal ones go to the oldest bin; without one a bin is opened. Bins that can't take even the smallest
    item left are closed.
    """
    share = sizes / caps
    order = np.lexsort((np.arange(len(share)), -share[:, 0]))
    smallest = np.minimum.accumulate(share[order][::-1], axis=0)[::-1]
    bin_of = np.empty(len(share), np.int64)
    left = np.empty((64, share.shape[1]))
    number = np.empty(64, np.int64)
    n_open = made = 0
    for i, item in enumerate(order):
        s = share[item]
        if i % 64 == 0 and n_open:
            keep = (left[:n_open] >= smallest[i] - 1e-12).all(1)
            kept = int(keep.sum())
            left[:kept], number[:kept] = left[:n_open][keep], number[:n_open][keep]
            n_open = kept
        rest = left[:n_open] - s
        fits = np.flatnonzero((rest >= -1e-12).all(1))
        if len(fits):
            value = (weights * rest[fits] ** 2).sum(1) if score == "residual" else -(weights * left[fits] * s).sum(1)
            at = fits[int(value.argmin())]
            left[at] = rest[at]
            bin_of[item] = number[at]
            continue
        if n_open == len(left):
            left, number = np.concatenate([left, left]), np.concatenate([number, number])
        left[n_open], number[n_open] = 1 - s, made
        bin_of[item] = made
        made += 1
        n_open += 1
    return bin_of


def packs(
    sized: DataFrame, capacities: DataFrame, key: str = "doc_id", max_items: int = 64, cost_share: float = COST_SHARE,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "residual", shard: int = SHARD,
) -> DataFrame:
    """(pack_name, pack_id, key, piece_no, piece_start, n_tokens): every item of sized (key, n_tokens) in packs of each capacity.

    capacities: (pack_name, capacity). An item above the capacity is cut into full pieces, which are packs of their own,
    and one rest; no other item is cut. A pack holds at most `capacity` tokens, `max_items` items and an attention cost
    (sum of squared sizes) of cost_share x capacity^2; with an item that alone costs more, only items of no tokens may go. Items of no
    tokens take a place but no room; null sizes count as none; null or non-positive capacities make no packs. Items are
    dealt to shards of about `shard` by a hash of key, size and number among equal rows, so the packs don't depend on how the
    table is laid out and copies of one row can't pile up in a task; each shard is packed by best_fit, item by item, which
    best fit needs. Shards grow in number, not in size.
    """
    shards = max(1, -(-sized.count() // shard))
    alike = sized.groupBy(F.col(key).alias("_key"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("_n")).agg(F.count("*").alias("_c"))
    runs = alike.select("_key", "_n", "_c", F.explode(F.expr(f"sequence(0, (_c - 1) div {RUN})")).alias("_run"))
    hot = F.when(F.col("_run") > 0, F.col("_run")).otherwise(F.xxhash64("_key"))
    runs = runs.repartition(hot).select("_key", "_n", F.explode(F.expr(f"sequence(_run * {RUN}, least(_c, (_run + 1) * {RUN}) - 1)")).alias("_no"))
    items = runs.withColumn("_place", F.xxhash64("_key", "_n", "_no"))
    caps = capacities.where("capacity > 0 AND pack_name IS NOT NULL").groupBy("pack_name").agg(F.max("capacity").cast("bigint").alias("capacity"))
    named = [(r.pack_name, r.capacity) for r in caps.take(1001)]
    if len(named) > 1000:
        raise ValueError("more than 1000 capacities")
    choice = F.array(*[F.struct(F.lit(a).alias("pack_name"), F.lit(b).cast("bigint").alias("capacity")) for a, b in sorted(named)])
    items = items.select("*", F.inline(choice)) if named else items.select("*", F.lit("").alias("pack_name"), F.lit(1).cast("bigint").alias("capacity")).limit(0)
    items = items.withColumn("_shard", F.pmod(F.xxhash64("_place"), F.lit(shards)))
    full = items.where("_n > capacity").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("_n div capacity - 1"))).alias("_piece"))
    full = full.select(
        "pack_name", F.concat_ws("-", F.lit("f"), F.hex("_place"), F.col("_no"), F.col("_piece")).alias("pack_id"), F.col("_key").alias(key),
        F.col("_piece").cast("int").alias("piece_no"), (F.col("_piece") * F.col("capacity")).alias("piece_start"), F.col("capacity").alias("n_tokens"),
    )
    cut = F.col("_n") > F.col("capacity")
    rest = items.where("_n <= capacity OR _n % capacity > 0").select(
        "pack_name", "capacity", "_shard", "_place", "_no", "_key",
        F.when(cut, F.expr("_n div capacity")).otherwise(F.lit(0)).cast("int").alias("piece_no"),
        F.when(cut, F.expr("_n div capacity * capacity")).otherwise(F.lit(0)).cast("bigint").alias("piece_start"),
        F.when(cut, F.expr("_n % capacity")).otherwise(F.col("_n")).alias("n_tokens"),
    )
    key_type = sized.schema[key].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_place", "_no"], kind="stable").reset_index(drop=True)
        capacity = float(pdf["capacity"].iloc[0])
        t = pdf["n_tokens"].to_numpy(float)
        limits = np.array([capacity, max_items, cost_share * capacity**2])
        dims = np.minimum(np.c_[t, np.ones(len(t)), t**2], limits)
        bins = best_fit(dims, limits, np.array(weights), score)
        name = pdf["_shard"].astype(str) + "-" + pd.Series(bins).astype(str)
        return pd.DataFrame({"pack_name": pdf["pack_name"], "pack_id": name, key: pdf["_key"], "piece_no": pdf["piece_no"], "piece_start": pdf["piece_start"], "n_tokens": pdf["n_tokens"]})

    schema = f"pack_name string, pack_id string, `{key}` {key_type}, piece_no int, piece_start bigint, n_tokens bigint"
    packed = rest.groupBy("pack_name", "_shard").applyInPandas(pack, schema)
    return full.unionByName(packed)


def pack_report(packed: DataFrame, capacities: DataFrame, cost_share: float = COST_SHARE) -> DataFrame:
    """(pack_name, capacity, packs, tokens, fill, by_cost): how full the packs are, and how many are over 95 % of the attention cost
    while there is room for tokens, so that it was the cost that closed them."""
    caps = capacities.where("capacity > 0").groupBy("pack_name").agg(F.max("capacity").cast("bigint").alias("capacity"))
    n = F.col("n_tokens")
    each = packed.groupBy("pack_name", "pack_id").agg(F.sum(n).alias("n"), F.sum(n * n).alias("cost")).join(F.broadcast(caps), "pack_name")
    closed = (F.col("cost") > F.lit(0.95 * cost_share) * F.col("capacity") * F.col("capacity")) & (F.col("n") < 0.99 * F.col("capacity"))
    sums = each.groupBy("pack_name", "capacity").agg(F.count("*").alias("packs"), F.sum("n").alias("tokens"), F.count_if(closed).alias("by_cost"))
    return sums.select("pack_name", "capacity", "packs", "tokens", (F.col("tokens") / (F.col("packs") * F.col("capacity"))).alias("fill"), "by_cost")


def pack_limits(packed: DataFrame, sized: DataFrame, capacities: DataFrame, max_items: int = 64, cost_share: float = COST_SHARE) -> DataFrame:
    """(pack_name, whole, capacity_kept, items_kept, cost_kept): whether all tokens are packed once, and whether every pack keeps
    each limit (the cost one but for packs with a single item of any tokens)."""
    caps = capacities.where("capacity > 0 AND pack_name IS NOT NULL").groupBy("pack_name").agg(F.max("capacity").cast("bigint").alias("capacity"))
    n = F.col("n_tokens")
    each = packed.groupBy("pack_name", "pack_id").agg(F.sum(n).alias("n"), F.count("*").alias("items"), F.count_if(n > 0).alias("filled"), F.sum(n * n).alias("cost")).join(F.broadcast(caps), "pack_name")
    limit = F.lit(cost_share) * F.col("capacity") * F.col("capacity")
    sums = each.groupBy("pack_name").agg(
        F.sum("n").alias("packed"), F.min(F.col("n") <= F.col("capacity")).alias("capacity_kept"), F.min(F.col("items") <= max_items).alias("items_kept"),
        F.min((F.col("cost") <= limit * (1 + 1e-9)) | (F.col("filled") <= 1)).alias("cost_kept"),
    )
    total = sized.agg(F.sum("n_tokens").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("pack_name", (F.col("packed") == F.col("total")).alias("whole"), "capacity_kept", "items_kept", "cost_kept")
