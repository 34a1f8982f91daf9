"""Choosing a varied subset: multi-attribute grid round-robin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.functions.content import hash_key
from gridloom.session import cut

# The mean of every third grid value from one of L, A, B in one half of the picture.
_MEAN = "aggregate(sequence({first}, {last}, 3), 0D, (s, i) -> s + try_element_at(grid4x4, i)) / 32"

CELLS = f"""
SELECT id, mean_brightness, use_count, hv,
       CASE WHEN size(grid4x4) = 192 THEN 1 ELSE 0 END AS has_grid, grid4x4
FROM {{images}}
"""

BINNED = f"""
SELECT id, hv, greatest(coalesce(use_count, 0), 0) AS uses,
       coalesce(floor(mean_brightness / 32), -1) AS c_bright,
       CASE WHEN has_grid = 1 THEN coalesce(floor({_MEAN.format(first=1, last=94)} / 32), -1) ELSE -1 END AS c_top,
       CASE WHEN has_grid = 1 THEN coalesce(floor({_MEAN.format(first=97, last=190)} / 32), -1) ELSE -1 END AS c_low,
       CASE WHEN has_grid = 1 THEN coalesce(floor(({_MEAN.format(first=2, last=95)} + {_MEAN.format(first=98, last=191)}) / 32), -1) ELSE -1 END AS c_a,
       CASE WHEN has_grid = 1 THEN coalesce(floor(({_MEAN.format(first=3, last=96)} + {_MEAN.format(first=99, last=192)}) / 32), -1) ELSE -1 END AS c_b,
       CASE WHEN coalesce(use_count, 0) <= 0 THEN 0 WHEN use_count < 4 THEN 1 WHEN use_count < 16 THEN 2 ELSE 3 END AS c_use
FROM {{cells}}
"""

CELL = "xxhash64(c_bright, c_top, c_low, c_a, c_b, c_use)"

KEYED = f"""
SELECT b.id, b.uses, {CELL} AS cell,
       CASE WHEN b.hv IS NULL OR f.first_id IS NOT NULL THEN 0 ELSE 1 END AS copy,
       xxhash64(b.id) AS h
FROM {{binned}} b LEFT JOIN (SELECT hv, min(id) AS first_id FROM {{binned}} WHERE hv IS NOT NULL GROUP BY hv) f ON b.id = f.first_id
"""

SLICED = """
SELECT cell, copy, uses, shiftrightunsigned(h, 54) AS slice, count(*) AS n
FROM {keyed} GROUP BY cell, copy, uses, shiftrightunsigned(h, 54)
"""

OFFSETS = """
SELECT s.cell, s.copy, s.uses, s.slice,
       t.before + coalesce(sum(s.n) OVER (PARTITION BY s.cell, s.copy, s.uses ORDER BY s.slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM {sliced} s JOIN (
  SELECT cell, copy, uses, coalesce(sum(n) OVER (PARTITION BY cell ORDER BY copy, uses ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT cell, copy, uses, sum(n) AS n FROM {sliced} GROUP BY cell, copy, uses)) t
ON s.cell = t.cell AND s.copy = t.copy AND s.uses = t.uses
"""

PLAN = """
WITH sizes AS (SELECT cell, sum(n) AS cnt FROM {sliced} GROUP BY cell),
steps AS (SELECT cnt, count(*) AS cells FROM sizes GROUP BY cnt),
sums AS (
  SELECT cnt, coalesce(sum(cnt * cells) OVER (ORDER BY cnt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(cells) OVER (ORDER BY cnt DESC) AS open, coalesce(lag(cnt) OVER (ORDER BY cnt), 0) AS low
  FROM steps),
want AS (SELECT least({k}, sum(cnt)) AS k FROM sizes),
cutoff AS (
  SELECT max(CASE WHEN used + open * low <= k THEN least(cnt, (k - used) div open) END) AS full_rounds
  FROM sums CROSS JOIN want),
part AS (
  SELECT full_rounds, k - (SELECT sum(least(cnt, full_rounds)) FROM sizes CROSS JOIN cutoff) AS rest FROM cutoff CROSS JOIN want)
SELECT s.cell, p.full_rounds + CASE WHEN s.cnt > p.full_rounds AND row_number() OVER (ORDER BY CASE WHEN s.cnt > p.full_rounds THEN 0 ELSE 1 END, s.cell) <= p.rest THEN 1 ELSE 0 END AS take
FROM sizes s CROSS JOIN part p
"""

CHOSEN = """
SELECT id, cell, rank FROM (
  SELECT w.id, w.cell, o.before + w.nr AS rank
  FROM (SELECT *, shiftrightunsigned(h, 54) AS slice,
               row_number() OVER (PARTITION BY cell, copy, uses, shiftrightunsigned(h, 54) ORDER BY h, id) AS nr FROM {keyed}) w
  JOIN {offsets} o ON w.cell = o.cell AND w.copy = o.copy AND w.uses = o.uses AND w.slice = o.slice) r
JOIN {plan} p USING (cell) WHERE r.rank <= p.take
"""


COVERAGE = """
WITH have AS (SELECT cell, count(*) AS n FROM {cells} GROUP BY cell), got AS (SELECT cell, count(*) AS n FROM {chosen} GROUP BY cell)
SELECT count(*) AS cells, count(g.cell) AS covered, coalesce(sum(h.n), 0) AS images, coalesce(sum(g.n), 0) AS chosen,
       max(h.n) / sum(h.n) AS largest_share, max(g.n) / sum(g.n) AS largest_chosen_share
FROM have h LEFT JOIN got g ON h.cell = g.cell
"""


def _binned(images: DataFrame) -> DataFrame:
    spark = images.sparkSession
    source = images.select("id", "mean_brightness", "use_count", "grid4x4", hash_key(images["file_hash"]).alias("hv"))
    return spark.sql(BINNED, cells=spark.sql(CELLS, images=source))


def coverage(images: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: cells there are and cells the chosen rows (cell) cover, and the largest cell's share before and after."""
    cells = _binned(images).selectExpr(f"{CELL} AS cell")
    return images.sparkSession.sql(COVERAGE, cells=cells, chosen=chosen)


def varied_subset(images: DataFrame, k: int) -> DataFrame:
    """(id, cell, rank): k rows (all, if there are fewer) spread over the cells of a grid on brightness, colour layout and use.

    Cells are taken in turn: every cell gives its first row before any gives its second, and so on; the last, partial round
    goes to the cells of smallest key. Within a cell the first image of each content comes before its copies, then the less
    used, then a fixed shuffle. Missing brightness and missing or short grids have bins of their own; negative or null
    counts are 0. Ranks of a hot cell are the sum of a use count's offset, a slice's offset and the rank within the slice, 1,024
    slices a use count, so no task holds a cell; copies of hot contents never meet, only their smallest id is computed. The plan per
    cell covers all cells (their number is bounded by the bins), none is dropped.
    """
    spark = images.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "id bigint, cell bigint, rank bigint")
    binned = _binned(images)
    keyed = cut(spark.sql(KEYED, binned=binned))
    sliced = cut(spark.sql(SLICED, keyed=keyed))
    offsets = spark.sql(OFFSETS, sliced=sliced)
    plan = spark.sql(PLAN, sliced=sliced, k=int(k))
    return spark.sql(CHOSEN, keyed=keyed, offsets=offsets, plan=plan)
