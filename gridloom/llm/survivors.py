"""Best representative of each duplicate group, by votes per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Votes are counted in whole units of this size, so that sums don't depend on their order.
UNIT = 1e9


def recency_decay(made_at: Column, as_of: str, half_life_days: float, missing: float) -> Column:
    """Share of a vote that is left after the record's age in whole days; null and 1970-01-01 00:00:00 have `missing`.

    Records newer than as_of count as made then. Never below `missing` plus a tenth of it, so a known time outweighs none.
    """
    age = F.datediff(F.lit(as_of).cast("date"), made_at.cast("date"))
    decay = F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / F.lit(float(half_life_days)))
    known = made_at.isNotNull() & (made_at != F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.when(known, F.greatest(decay, F.lit(missing * 1.1))).otherwise(F.lit(missing))


def surviving_records(df: DataFrame, group: Column, fields: dict[str, Column], trust: Column, decay: Column, tie: Column, least: int = 2) -> DataFrame:
    """One row per group of at least `least` records: group, records, and for each field the value with the most votes.

    Fields are unpivoted to long rows; each row's non-null value gets trust x decay votes, equal values of a group add up,
    and the value with the most votes wins; equal votes go to the larger `tie` (a struct), then to the larger text. Rows
    with a null group belong to none. A field no record fills is null. Every repeated row votes again. Both steps aggregate
    before they shuffle, so a group holding a third of all rows moves as one partial row per task and value.
    Only the named expressions are used: other columns, whatever their names, don't matter.
    """
    vote = F.coalesce((trust * decay * F.lit(UNIT)).cast("bigint"), F.lit(0))
    base = df.select(group.alias("g"), vote.alias("vote"), tie.alias("tie"), *[v.cast("string").alias(f"f_{k}") for k, v in fields.items()]).where("g IS NOT NULL")
    unit = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("value")), *[F.struct(F.lit(k).alias("field"), F.col(f"f_{k}").alias("value")) for k in fields])
    long = base.select("g", "vote", "tie", F.inline(unit)).where("value IS NOT NULL")
    # A sum of BIGINTs would overflow where a content has hundreds of thousands of records.
    votes = long.groupBy("g", "field", "value").agg(F.sum(F.col("vote").cast("decimal(20,0)")).alias("votes"), F.max("tie").alias("tie"), F.count("*").alias("n"))
    chosen = [
        F.max_by(F.when(F.col("field") == k, F.col("value")), F.when(F.col("field") == k, F.struct("votes", "tie", "value"))).alias(k)
        for k in fields
    ]
    records = F.sum(F.when(F.col("field") == "", F.col("n"))).alias("records")
    return votes.groupBy("g").agg(records, *chosen).where(F.col("records") >= least)
