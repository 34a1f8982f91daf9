"""Most similar vectors for every vector: multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.imaging import bounded_sample, column, numbers, unpack, vectors_of
from gridloom.session import cut

BITS = 64
#: Rows the rotation and the reach of distances in bits are learned from, at most; of these, rows whose neighbours are looked at,
#: and neighbours a row.
SAMPLE = 16384
LEARNERS = 4096
LEARNED = 50
#: Share of neighbours whose codes may lie beyond the radius a distance asks for.
MISSED = 0.002
#: Most bits flipped in a part while its index is probed; beyond, all rows are compared.
FLIPS = 2
#: Queries whose vectors are broadcast at once: 64 MB.
BLOCK = 40_000


def parts_for(n: int) -> list[int]:
    """Widths of a code's parts: about log2 n bits each, so that a value of a part has few rows whatever the number of rows."""
    count = max(2, min(8, round(BITS / max(8.0, math.log2(max(n, 2))))))
    return [BITS // count] * (count - 1) + [BITS - BITS // count * (count - 1)]


def feature_rows(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The 194 numbers: avg_l / 255, the grid / 255, edge density."""
    vec = vectors_of(b) if isinstance(b, pa.Table) else unpack(column(b, "vec"))
    side = np.column_stack([np.asarray(b.column(b.schema.get_field_index(c)).to_numpy() if isinstance(b, pa.Table) else column(b, c).to_numpy(zero_copy_only=False)) for c in ("avg_l", "edge")])
    return np.column_stack([side[:, :1] / 255, vec.astype(np.float64) / 255, side[:, 1:]])


def learn_codes(x: np.ndarray, rounds: int = 40, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x BITS): principal directions, rotated so that signs lose the least."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    z = x - mean
    _, v = np.linalg.eigh(z.T @ z)
    basis = v[:, ::-1][:, :BITS]
    y = z @ basis
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(BITS, BITS)))[0]
    for _ in range(rounds if len(x) else 0):
        u, _, vt = np.linalg.svd(np.sign(y @ r).T @ y)
        r = (u @ vt).T
    return mean, basis @ r


def _encode(x: np.ndarray, mean: np.ndarray, w: np.ndarray) -> np.ndarray:
    bits = ((x - mean) @ w > 0).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0]


def learn_reach(x: np.ndarray, mean: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances, bits), both rising: of the sample's neighbours up to a distance, all but a share of MISSED had codes at most that
    many bits apart. Beyond the last distance nothing is known."""
    if len(x) < 2:
        return np.zeros(0), np.zeros(0, int)
    codes = _encode(x, mean, w).view(np.uint64)
    norms = (x**2).sum(1)
    apart, bits = [], []
    step = max(1, len(x) // LEARNERS)
    for s in range(0, len(x), 256 * step):
        rows = np.arange(s, min(s + 256 * step, len(x)), step)
        d = np.sqrt(np.maximum(norms[rows, None] + norms[None] - 2 * (x[rows] @ x.T), 0))
        d[np.arange(len(rows)), rows] = np.inf
        near = np.argpartition(d, min(LEARNED, len(x) - 1) - 1, axis=1)[:, : min(LEARNED, len(x) - 1)]
        apart.append(np.take_along_axis(d, near, 1).ravel())
        bits.append(np.bitwise_count(codes[rows][:, None] ^ codes[near]).ravel().astype(int))
    d, h = np.concatenate(apart), np.concatenate(bits)
    order = np.argsort(d, kind="stable")
    d, h = d[order], h[order]
    edge = np.unique(np.linspace(0, len(d), min(64, len(d)) + 1).astype(int))
    bits = [int(np.ceil(np.quantile(h[a:b], 1 - MISSED))) for a, b in zip(edge[:-1], edge[1:])]
    return d[edge[1:] - 1], np.maximum.accumulate(bits)


def needed_bits(reach: tuple[np.ndarray, np.ndarray], distance: np.ndarray) -> np.ndarray:
    """Bits within which rows at most `distance` away are expected; more than BITS where the sample says nothing."""
    at = np.searchsorted(reach[0], distance, side="left")
    return np.where(at < len(reach[0]), np.append(reach[1], BITS + 1)[np.minimum(at, len(reach[0]))], BITS + 1)


def _part(code: F.Column, i: int, widths: list[int]) -> F.Column:
    moved = F.shiftrightunsigned(code, sum(widths[:i])) if i else code
    return moved if widths[i] == BITS else moved.bitwiseAND(F.lit((1 << widths[i]) - 1))


def _parts(widths: list[int], code: str = "code") -> F.Column:
    return F.array(*[F.struct(F.lit(i).alias("part"), _part(F.col(code), i, widths).alias("value")) for i in range(len(widths))])


def _masks(width: int, flips: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(width), n)]


def within_radius(codes: DataFrame, queries: DataFrame, radius: int, widths: list[int] | None = None) -> DataFrame:
    """(q, id): every code within `radius` bits of a query's code, each once.

    queries: (q, own, code). Two codes within the radius differ in at most radius // parts bits of some part, so each query
    probes every value that near in the index of each part. A pair met in several parts counts in the first one only.
    """
    widths = widths or [16, 16, 16, 16]
    near = radius // len(widths)
    probe = queries.select("q", "own", F.col("code").alias("q_code"), F.inline(_parts(widths)))
    by_part = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in _masks(w, near)]) for w in sorted(set(widths))])
    mask = F.explode(by_part[F.when(F.col("part") == len(widths) - 1, len(set(widths)) - 1).otherwise(0)] if len(set(widths)) > 1 else by_part[0])
    probe = probe.select("q", "own", "q_code", "part", "value", mask.alias("mask")).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    index = codes.select("id", "code", F.inline(_parts(widths)))
    hit = probe.join(index, ["part", "value"])
    apart = F.col("code").bitwiseXOR(F.col("q_code"))
    first = F.lit(True)
    for i in range(len(widths) - 1):
        first = first & ((F.col("part") <= i) | (F.bit_count(_part(apart, i, widths)) > near))
    return hit.where((F.bit_count(apart) <= radius) & first & (F.col("id") != F.col("own"))).select("q", "id")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(1))


def _keep_best(best_d: np.ndarray, best_i: np.ndarray, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
    """Puts rows (ids, d) of queries q among the best of each query (a line per query, nearest first, ties to the smaller id)."""
    k = best_d.shape[1]
    touched = np.unique(q)
    all_q = np.concatenate([np.repeat(touched, k), q])
    all_d = np.concatenate([best_d[touched].ravel(), d])
    all_i = np.concatenate([best_i[touched].ravel(), ids])
    o = np.lexsort((all_i, all_d, all_q))
    all_q = all_q[o]
    start = np.flatnonzero(np.r_[True, all_q[1:] != all_q[:-1]])
    pick = o[start[:, None] + np.arange(k)]
    best_d[touched], best_i[touched] = all_d[pick], all_i[pick]


class QueryIndex:
    """Multi-index of a query block's codes: by each part, its values in order with their queries."""

    def __init__(self, codes: np.ndarray, widths: list[int]):
        self.codes, self.widths = codes.view(np.uint64), widths
        self.parts = []
        for i in range(len(widths)):
            value = self._part(self.codes, i)
            order = np.argsort(value, kind="stable")
            ends = np.searchsorted(value[order], np.arange((1 << widths[i]) + 1, dtype=np.uint64)) if widths[i] <= 16 else None
            self.parts.append((value[order], order, ends))

    def _part(self, codes: np.ndarray, i: int) -> np.ndarray:
        return codes >> np.uint64(sum(self.widths[:i])) & np.uint64((1 << self.widths[i]) - 1)

    def within(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, query): codes within `radius` bits of each other, each pair once, as within_radius finds them."""
        codes, near = codes.view(np.uint64), radius // len(self.widths)
        rows, queries = [], []
        for i, (values, order, ends) in enumerate(self.parts):
            probe = self._part(codes, i)[:, None] ^ np.array(_masks(self.widths[i], near), np.uint64)[None]
            if ends is not None:
                first, last = ends[probe], ends[probe + np.uint64(1)]
            else:
                first, last = np.searchsorted(values, probe), np.searchsorted(values, probe, "right")
            r, m = np.nonzero(last > first)
            start, size = first[r, m], (last - first)[r, m]
            row = np.repeat(r, size)
            q = order[np.repeat(start - np.cumsum(size) + size, size) + np.arange(len(row))]
            apart = codes[row] ^ self.codes[q]
            good = np.bitwise_count(apart) <= radius
            for j in range(i):
                good &= np.bitwise_count(self._part(apart, j)) > near
            rows.append(row[good])
            queries.append(q[good])
        return np.concatenate(rows), np.concatenate(queries)


def probe_block(comparable: DataFrame, queries: pa.Table, radius: int, widths: list[int], mean: np.ndarray, w: np.ndarray, k: int) -> DataFrame:
    """(q, id, distance): each task's k nearest of the rows whose codes are within `radius` bits of a query's, by the vectors themselves.

    The block's queries (at most BLOCK) are broadcast with a multi-index of their codes, which every row probes where it lies:
    neither rows nor candidate pairs move."""
    x = feature_rows(queries)
    index = QueryIndex(_encode(x, mean, w), widths)
    shared = comparable.sparkSession.sparkContext.broadcast((queries.column("q").to_numpy(), queries.column("own").to_numpy(), x, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, own, qx, index = shared.value
        none = np.iinfo(np.int64).max
        best_d, best_i = np.full((len(qs), k), np.inf), np.full((len(qs), k), none)
        for whole in batches:
            for s in range(0, len(whole), 1024):
                b = whole.slice(s, 1024)
                ids, x = column(b, "id").to_numpy(), feature_rows(b)
                r, q = index.within(_encode(x, mean, w), radius)
                keep = ids[r] != own[q]
                r, q = r[keep], q[keep]
                if len(q):
                    d = np.concatenate([_distances(x[r[t : t + 8192]], qx[q[t : t + 8192]]) for t in range(0, len(q), 8192)])
                    some = d <= best_d[q, -1]
                    if some.any():
                        _keep_best(best_d, best_i, q[some], ids[r[some]], d[some])
        q, n = np.nonzero(best_i < none)
        yield pa.RecordBatch.from_arrays([pa.array(qs[q]), pa.array(best_i[q, n]), pa.array(best_d[q, n])], names=["q", "id", "distance"])

    return comparable.select("id", "avg_l", "edge", "vec").mapInArrow(run, "q bigint, id bigint, distance double")


def scan_block(comparable: DataFrame, queries: pa.Table, k: int, reach: np.ndarray | None = None) -> DataFrame:
    """(q, id, distance): each task's k nearest rows of a stated block of queries (broadcast, at most BLOCK), by all rows.

    reach: a distance per query within which k rows are known to lie; rows beyond it are left out."""
    reach = np.full(len(queries), np.inf) if reach is None else reach
    shared = comparable.sparkSession.sparkContext.broadcast((queries.column("q").to_numpy(), queries.column("own").to_numpy(), feature_rows(queries), reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, own, qx, reach = shared.value
        q32, qn = -2 * qx.astype(np.float32), (qx**2).sum(1).astype(np.float32)[:, None]
        none = np.iinfo(np.int64).max
        best_d = np.repeat(reach[:, None], k, axis=1)
        best_i = np.full((len(qs), k), none)
        step = max(64, 4_000_000 // max(len(qs), 1))
        for whole in batches:
            for s in range(0, len(whole), step):
                b = whole.slice(s, step)
                ids, x = column(b, "id").to_numpy(), feature_rows(b)
                rough = q32 @ x.astype(np.float32).T
                rough += (x**2).sum(1).astype(np.float32)[None]
                bound = (best_d[:, -1:] ** 2 + 1e-3).astype(np.float32) - qn
                open_ = np.flatnonzero(~np.isfinite(bound[:, 0]))
                if len(open_) and len(ids) > k:
                    # A query has k rows of this batch at least this near (one more in case it meets itself).
                    bound[open_, 0] = np.partition(rough[open_], k, axis=1)[:, k] + np.float32(2e-3)
                q, r = np.nonzero(rough <= bound)
                keep = ids[r] != own[q]
                q, r = q[keep], r[keep]
                if not len(q):
                    continue
                d = np.concatenate([_distances(qx[q[t : t + 8192]], x[r[t : t + 8192]]) for t in range(0, len(q), 8192)])
                _keep_best(best_d, best_i, q, ids[r], d)
        q, n = np.nonzero(best_i < none)
        yield pa.RecordBatch.from_arrays([pa.array(qs[q]), pa.array(best_i[q, n]), pa.array(best_d[q, n])], names=["q", "id", "distance"])

    return comparable.select("id", "avg_l", "edge", "vec").mapInArrow(run, "q bigint, id bigint, distance double")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_images(comparable: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """(q, id, distance, rank): the k nearest comparable images of every asked one (q, own), itself excluded; ties to the smaller id.

    A rotation learned from at most SAMPLE rows turns each of the 194-number vectors into a 64-bit code; a query block's codes
    are indexed by their parts, whose width follows the number of rows. Rows probe with no, one, ... FLIPS bits of a part flipped,
    that is a growing radius, and what they meet is ranked by exact distance. A query is answered once it has k rows and
    its k-th distance is one whose neighbours' codes, as learned from the sample, lie within the radius. Queries that find fewer
    rows, or whose distance no radius left would do for, are of images without near ones; they are answered from all rows
    within the k-th distance found, in blocks. Null and unknown `own` ids have no neighbours; repeated q count once. Queries are handled
    BLOCK at a time; only their vectors are broadcast.
    """
    spark = comparable.sparkSession
    widths = parts_for(comparable.count())
    x = feature_rows(bounded_sample(comparable, SAMPLE, ["id", "avg_l", "edge", "vec"]))
    mean, w = learn_codes(x)
    reach_of = learn_reach(x, mean, w)
    asked = cut(asked.where("q IS NOT NULL").groupBy("q").agg(F.min("own").alias("own")))
    few = F.broadcast(asked) if asked.count() <= BLOCK else asked
    queries = cut(few.join(comparable.select(F.col("id").alias("own"), "avg_l", "edge", "vec"), "own"))
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    result = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) if blocks > 1 else queries
        vectors = block.toArrow()
        q_all = vectors.column("q").to_numpy()
        kth = np.full(len(vectors), np.inf)
        left = np.arange(len(vectors))
        rungs = [len(widths) * (f + 1) - 1 for f in range(FLIPS + 1)]
        # A radius that even the nearest neighbours of the sample need more than answers nothing.
        rungs = [r for r in rungs if not len(reach_of[1]) or r >= reach_of[1][0]] or rungs[-1:]
        for radius in rungs:
            if not len(left):
                break
            got = cut(_nearest(probe_block(comparable, vectors.take(pa.array(left)), radius, widths, mean, w, k), k))
            last = got.where(F.col("rank") == k).select("q", "distance").toArrow()
            at = dict(zip(q_all[left].tolist(), left.tolist()))
            where = [at[q] for q in last.column("q").to_pylist()]
            kth[where] = last.column("distance").to_numpy()
            bits = needed_bits(reach_of, kth)
            done = left[bits[left] <= radius]
            answered = spark.createDataFrame(vectors.select(["q"]).take(pa.array(done)))
            part = got.join(answered, "q", "left_semi")
            result = part if result is None else result.unionByName(part)
            left = left[bits[left] > radius]
            # Probing on is of use where k rows are there and their distance is within the reach of a larger radius.
            stop = left[bits[left] > rungs[-1]]
            if len(stop):
                scanned = scan_block(comparable, vectors.take(pa.array(stop)), k, kth[stop] * (1 + 1e-9))
                result = result.unionByName(_nearest(scanned, k))
                left = np.setdiff1d(left, stop)
    return result if result is not None else _nearest(scan_block(comparable, queries.limit(0).toArrow(), k), k)
