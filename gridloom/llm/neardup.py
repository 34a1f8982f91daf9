"""Near-duplicate images with small edits: MinHash bands, Bayesian candidate pruning, exact verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.imaging import CELLS, column, numbers, unpack
from gridloom.session import cut

# The problem's limits.
AVERAGE = 8.0
CELL = 5.0
AGREE = 58

#: Width of a quantised cell value; MinHash values kept for pruning.
STEP = 24.0
KEPT = 64
#: Bands are laid out so that sets of this similarity - about that of pairs at the problem's limits - meet with this chance.
LIMIT_SIMILARITY = 0.48
MEET = 0.92
#: Images up to which a band has three MinHash values; every tenfold adds one.
FIRST_SIZE = 1_000_000
#: Candidates stay while the chance that their sets' similarity reaches REACH is at least TOLERANCE.
REACH = 0.4
TOLERANCE = 1e-3

#: Folded cell positions (of 32) whose cells ride along where pairs meet, and the width of their quantised values.
WATCHED = 7
WATCH_STEP = 5.0
#: MinHash values of all bands that constants are drawn for.
_MOST = 1 << 16

_rng = np.random.default_rng(20240229)
_SHIFT = _rng.uniform(0, STEP, (8, 4, 3)).astype(np.float32)
_ODD = _rng.integers(0, 2**32, _MOST + KEPT, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, _MOST + KEPT, dtype=np.uint64).astype(np.uint32)
_PLACES = _rng.permutation(32)[:WATCHED]

#: In a word of three bits a value: the lowest bits of every other value, and of one channel's seven values.
_EVEN = np.uint64(sum(7 << 6 * i for i in range(11)))
_LOW = np.uint64(sum(1 << 6 * i for i in range(11)))
_CHANNEL = np.uint64((1 << 3 * WATCHED) - 1)


def geometry(n: int) -> tuple[int, int]:
    """(bands, values a band) for n images: more values where more images could meet by chance, and as many bands as keep the
    chance of a meeting at LIMIT_SIMILARITY at MEET."""
    rows = 3 + max(0, math.ceil(math.log10(max(n, 1) / FIRST_SIZE)))
    return math.ceil(math.log(1 - MEET) / math.log1p(-(LIMIT_SIMILARITY**rows))), rows


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def tokens(grid: np.ndarray) -> np.ndarray:
    """64 tokens an image: a cell's row, its column counted from the nearer side, and its quantised L, A, B.

    A mirrored image has the same tokens, so one signature finds both kinds of pair.
    """
    cells = grid.reshape(-1, 8, 8, 3)
    cells = np.stack([cells[:, :, :4], cells[:, :, :3:-1]], axis=3)  # row, folded column, side, channel
    q = np.floor((cells + _SHIFT[None, :, :, None]) / np.float32(STEP)).astype(np.uint32)
    where = np.arange(32, dtype=np.uint32).reshape(1, 8, 4, 1)
    with np.errstate(over="ignore"):
        return _mix32((((where * np.uint32(64) + q[..., 0]) * np.uint32(64) + q[..., 1]) * np.uint32(64) + q[..., 2]).reshape(-1, CELLS))


def minhashes(tok: np.ndarray, first: int, last: int) -> np.ndarray:
    out = np.empty((len(tok), last - first), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(first, last):
            h = (tok ^ _ADD[i]) * _ODD[i]
            out[:, i - first] = (h ^ (h >> np.uint32(15))).min(1)
    return out


def _bands(tok: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One BIGINT key per band: the band's number mixed with its MinHash values."""
    m = minhashes(tok, KEPT, KEPT + bands * rows).reshape(-1, bands, rows)
    with np.errstate(over="ignore"):
        low, high = (np.broadcast_to(np.arange(bands, dtype=np.uint32)[None, :] * np.uint32(c), m.shape[:2]) for c in (0x9E3779B1, 0x7FEB352D))
        for r in range(rows):
            low = _mix32(low ^ m[:, :, r]) + np.uint32(r + 1)
            high = _mix32(high + m[:, :, r] * np.uint32(0x846CA68B)) ^ low
    return (high.astype(np.uint64) << np.uint64(32) | low).view(np.int64)


def watched(grid: np.ndarray) -> np.ndarray:
    """Two words an image: the cells at the watched places of the left half, and their mirror images, three bits a value."""
    cells = np.floor(grid.reshape(-1, 8, 8, 3) / np.float32(WATCH_STEP)).astype(np.uint64) & np.uint64(7)
    row, col = _PLACES // 4, _PLACES % 4
    shift = (np.arange(3)[None, :] * 3 * WATCHED + np.arange(WATCHED)[:, None] * 3).astype(np.uint64)
    return np.stack([(cells[:, row, c] << shift).sum((1, 2), dtype=np.uint64) for c in (col, 7 - col)], axis=1)


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the seven cells of two words cannot agree: some value is more than one step away, counted modulo eight.

    Values within 5 are at most one step of 5 apart, so a pair within the limits is never counted against."""
    bad = np.zeros(len(a), np.uint64)
    for half in (np.uint64(0), np.uint64(3)):
        x, y = a >> half & _EVEN, b >> half & _EVEN
        near = ((x | _LOW << np.uint64(3)) - y + _LOW) & _EVEN  # 0, 1 or 2 where at most one step apart
        bad |= ((near + _LOW * np.uint64(5)) >> np.uint64(3) & _LOW) << half
    bad = bad | bad >> np.uint64(3 * WATCHED) | bad >> np.uint64(6 * WATCHED)
    return np.bitwise_count(bad & _CHANNEL)


def possible(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows of watched words can agree in AGREE cells, as stored or mirrored: at most CELLS - AGREE cells are unlike."""
    straight = _unlike(left[:, 0], right[:, 0]) + _unlike(left[:, 1], right[:, 1])
    mirrored = _unlike(left[:, 0], right[:, 1]) + _unlike(left[:, 1], right[:, 0])
    return np.minimum(straight, mirrored) <= CELLS - AGREE


def _band_rows(bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, len(whole), 2000):
                b = whole.slice(s, 2000)
                grid = unpack(column(b, "vec"))
                words = watched(grid).view(np.int64)
                columns = [_bands(tokens(grid), bands, rows).ravel(), *(np.repeat(c, bands) for c in (column(b, "id").to_numpy(), words[:, 0], words[:, 1]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "w0", "w1"])

    return run


def _pairs_of_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of images that share a band and can agree in enough cells; the slice's rows are 32 bytes each."""
    got = [[column(b, c).to_numpy() for c in ("key", "id", "w0", "w1")] for b in batches]
    if not got:
        return
    key, rep, *words = (np.concatenate(x) for x in zip(*got))
    del got
    order = np.argsort(key, kind="stable")
    key, rep, words = key[order], rep[order], np.column_stack(words)[order].view(np.uint64)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    end = np.repeat(start + size, size)
    # Row i meets rows i+1 .. end of its bucket; steps are laid out in pieces of bounded size.
    todo = end - np.arange(len(key)) - 1
    rows = np.flatnonzero(todo)
    ahead = np.cumsum(todo[rows])
    at = 0
    while at < len(rows):
        base = ahead[at - 1] if at else 0
        r = rows[at : max(at + 1, int(np.searchsorted(ahead, base + 200_000)))]
        i = np.repeat(r, todo[r])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(todo[r]) - todo[r], todo[r])
        good = np.flatnonzero(possible(words[i], words[j]) & (rep[i] != rep[j]))
        if len(good):
            x, y = rep[i[good]], rep[j[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])
        at += len(r)


def _chance(matches: int, of: int, power: int) -> float:
    """Chance that the similarity s is at least REACH after `matches` of `of` values of s**power agreed (uniform prior)."""
    s = (np.arange(2000) + 0.5) / 2000
    p = np.clip(s**power, 1e-12, 1 - 1e-12)
    log = matches * np.log(p) + (of - matches) * np.log1p(-p)
    w = np.exp(log - log.max())
    return float(w[s >= REACH].sum() / w.sum())


def least_matches(of: int, power: int) -> int:
    """The fewest agreeing values at which a candidate stays."""
    return next(m for m in range(of + 1) if _chance(m, of, power) >= TOLERANCE)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sig): a byte of each MinHash value kept for pruning."""
    for whole in batches:
        for s in range(0, len(whole), 4000):
            b = whole.slice(s, 4000)
            m = minhashes(tokens(unpack(column(b, "vec"))), 0, KEPT)
            data = np.ascontiguousarray((m >> np.uint32(8)).astype(np.uint8)).reshape(-1)
            offsets = np.arange(len(b) + 1, dtype=np.int32) * KEPT
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(offsets), pa.py_buffer(data)])], names=["id", "sig"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares MinHash values eight at a time and drops pairs as soon as they fall below the least count."""
    steps = [(n, least_matches(n, 1)) for n in range(8, KEPT + 1, 8)]
    for b in batches:
        if not len(b):
            continue
        x, y = (np.frombuffer(b"".join(column(b, c).to_pylist()), np.uint8).reshape(-1, KEPT) for c in ("sig_x", "sig_y"))
        alive = np.arange(len(b))
        count = np.zeros(len(b), np.int32)
        done = 0
        for n, least in steps:
            count[alive] += (x[alive, done:n] == y[alive, done:n]).sum(1, dtype=np.int32)
            alive = alive[count[alive] >= least]
            done = n
        at = pa.array(alive)
        yield pa.RecordBatch.from_arrays([column(b, "x").take(at), column(b, "y").take(at)], names=["x", "y"])


def agreeing_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The larger number of agreeing cells of rows of a and b, as stored or with b mirrored."""
    a, b = a.reshape(-1, 8, 8, 3).astype(np.float64), b.reshape(-1, 8, 8, 3).astype(np.float64)
    return np.maximum(*((((a - c) ** 2).sum(3) <= CELL * CELL).sum((1, 2)) for c in (b, b[:, :, ::-1])))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for s in range(0, len(whole), 2000):
            b = whole.slice(s, 2000)
            near = (np.abs(numbers(b, "l_x", "a_x", "b_x") - numbers(b, "l_y", "a_y", "b_y")) <= AVERAGE).all(1)
            b = b.filter(pa.array(near))
            if len(b):
                good = pa.array(agreeing_cells(unpack(column(b, "vec_x")), unpack(column(b, "vec_y"))) >= AGREE)
                yield pa.RecordBatch.from_arrays([column(b, "x").filter(good), column(b, "y").filter(good)], names=["x", "y"])


def _only_named(vectors: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of vectors whose id may be in named (id): exact rows plus few chance ones, so that vectors of images without
    candidates aren't shuffled. The filter has eight slots a named id, between 2^20 and 2^27 (16 MB); beyond that more chance
    rows pass, which the join that follows drops."""
    spark = vectors.sparkSession
    bits = min(27, max(20, (8 * named.count()).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("slot")
    words = named.select(slot).select(F.shiftright("slot", 5).alias("word"), F.expr("shiftleft(1L, CAST(slot % 32 AS INT)) AS bit"))
    parts = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    flags = np.zeros(1 << (bits - 5), np.int64)
    flags[parts.column("word").to_numpy()] = parts.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(flags.astype(np.uint32))
    schema = vectors.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = column(b, "slot").to_numpy()
            yield b.filter(pa.array((shared.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))).select(schema.names)

    return vectors.select("*", slot).mapInArrow(run, schema)


def near_classes(comparable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, y) pairs of class representatives that nearly agree, and (rep, id) members of classes of exact copies.

    Of images equal in grid and averages, byte for byte, the one of smallest id stands for its class, so copies meet once;
    classes of one image are not listed. Bands of MinHash values make candidates (`geometry`). Where a band's images meet,
    14 coarse cells each show which pairs cannot agree in enough cells; this bound loses nothing. Every pair it leaves is
    pruned by its MinHash values, compared eight at a time while the posterior chance of reaching the similarity is above
    the tolerance, and what is left is verified on the vectors. Large buckets are gone through piece by piece; none is
    capped. Empty input, empty results.
    """
    n = comparable.count()
    bands, rows = geometry(n)
    slices = max(comparable.sparkSession.sparkContext.defaultParallelism, -(-n * bands // 500_000))
    member = comparable.select("id", "content")
    copied = member.groupBy("content").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = cut(member.join(copied, "content").where("id <> rep").select("id", "rep"))
    single = comparable.join(copies.select("id"), "id", "left_anti")
    met = single.select("id", "vec").mapInArrow(_band_rows(bands, rows), "key bigint, id bigint, w0 bigint, w1 bigint")
    met = met.repartition(slices, "key").mapInArrow(_pairs_of_slice, "x bigint, y bigint")
    met = met.repartition("x").distinct()
    sig = cut(single.select("id", "vec").mapInArrow(_signatures, "id bigint, sig binary"))
    left = met.join(sig.select(F.col("id").alias("x"), F.col("sig").alias("sig_x")), "x").join(sig.select(F.col("id").alias("y"), F.col("sig").alias("sig_y")), "y")
    left = cut(left.mapInArrow(_prune, "x bigint, y bigint"))
    named = left.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    wanted = cut(_only_named(single.select("id", "vec", "avg_l", "avg_a", "avg_b"), named))

    def side(s: str) -> DataFrame:
        return wanted.select(F.col("id").alias(s), F.col("vec").alias(f"vec_{s}"), F.col("avg_l").alias(f"l_{s}"), F.col("avg_a").alias(f"a_{s}"), F.col("avg_b").alias(f"b_{s}"))

    good = cut(left.join(side("x"), "x").join(side("y"), "y").mapInArrow(_verify, "x bigint, y bigint"))
    classes = copies.unionByName(copies.select(F.col("rep").alias("id"), "rep").distinct())
    return good, classes.select("rep", "id")


def near_duplicates(comparable: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller id first: pairs of comparable images with near averages and at least 58 agreeing cells.

    The pairs of near_classes between all members of their classes, and all pairs within a class, as the problem lists
    them; where classes are large, near_classes says the same in one row per image. Empty input, empty result.
    """
    good, classes = near_classes(comparable)
    x_all = good.join(classes.select(F.col("rep").alias("x"), F.col("id").alias("i")), "x", "left").select(F.coalesce("i", "x").alias("i"), "y")
    between = x_all.join(classes.select(F.col("rep").alias("y"), F.col("id").alias("j")), "y", "left").select("i", F.coalesce("j", "y").alias("j"))
    within = classes.select("rep", F.col("id").alias("i")).join(classes.select("rep", F.col("id").alias("j")), "rep").where("i < j").select("i", "j")
    return between.unionByName(within).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
