"""Comparable images as a written table of packed vectors, and Arrow helpers the image operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.content import hash_key
from gridloom.session import cut

CELLS = 64
VALUES = 192


QUARTERS = VALUES + VALUES // 4
RAW = 4 * VALUES


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def pack(values: np.ndarray) -> pa.Array:
    """Grid rows (0..255) as binary, without loss: whole quarters in 10 bits a value, other rows as float32 in byte planes."""
    values = np.ascontiguousarray(values, "<f4")
    scaled = values * 4
    short = (scaled == np.rint(scaled)).all(1)
    q = scaled[short].astype(np.uint16)
    high = (q >> 8).astype(np.uint8).reshape(-1, VALUES // 4, 4)
    small = np.concatenate([(q & 255).astype(np.uint8), high[:, :, 0] | high[:, :, 1] << 2 | high[:, :, 2] << 4 | high[:, :, 3] << 6], axis=1)
    lengths = np.where(short, QUARTERS, RAW)
    if short.all():
        return _binary(small.reshape(-1), lengths)
    planes = values[~short].view(np.uint8).reshape(-1, VALUES, 4).transpose(0, 2, 1).reshape(-1, RAW)
    start = np.cumsum(lengths) - lengths
    data = np.empty(int(lengths.sum()), np.uint8)
    data[start[short][:, None] + np.arange(QUARTERS)] = small
    data[start[~short][:, None] + np.arange(RAW)] = planes
    return _binary(data, lengths)


def unpack(packed: pa.Array) -> np.ndarray:
    """The rows pack() packed."""
    n = len(packed)
    out = np.zeros((n, VALUES), np.float32)
    if n == 0:
        return out
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + n + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)
    short = np.diff(offsets) == QUARTERS
    if short.all():
        small = data[offsets[0] : offsets[-1]].reshape(n, QUARTERS)
    else:
        small = data[offsets[:-1][short][:, None] + np.arange(QUARTERS)]
        planes = data[offsets[:-1][~short][:, None] + np.arange(RAW)]
        out[~short] = np.ascontiguousarray(planes.reshape(-1, 4, VALUES).transpose(0, 2, 1)).view("<f4").reshape(-1, VALUES)
    high = small[:, VALUES:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    out[short] = (small[:, :VALUES].astype(np.float32) + high.reshape(-1, VALUES).astype(np.float32) * 256) / 4
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbers(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.column_stack([column(batch, n).to_numpy(zero_copy_only=False) for n in names])


COMPARABLE = "id bigint, hv bigint, avg_l double, avg_a double, avg_b double, saturation double, edge double, vec binary, content bigint"


def _valid_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grids = column(b, "grid4x4")
        lengths = grids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        b = b.filter(pa.array(lengths == VALUES))
        if not len(b):
            continue
        flat = column(b, "grid4x4").flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, VALUES)
        good = ((values >= 0) & (values <= 255)).all(1)  # false for NaN, also for null
        b, values = b.filter(pa.array(good)), values[good]
        # Of a content's copies in this batch only the first can be the comparable one.
        hv = column(b, "hv")
        at = np.flatnonzero(np.asarray(hv.is_valid()))
        key, ids = hv.fill_null(0).to_numpy()[at], column(b, "id").to_numpy()[at]
        order = np.lexsort((ids, key))
        keep = np.ones(len(b), bool)
        keep[at[order[1:]]] = key[order[1:]] != key[order[:-1]]
        b, values = b.filter(pa.array(keep)), values[keep]
        averages = numbers(b, "avg_l", "avg_a", "avg_b").astype("<f8") if len(b) else np.zeros((0, 3))
        content = [xxhash.xxh3_64_intdigest(v.tobytes() + a.tobytes()) for v, a in zip(values, averages)]
        yield pa.RecordBatch.from_arrays(
            [column(b, n) for n in ("id", "hv", "avg_l", "avg_a", "avg_b", "saturation", "edge")] + [pack(values), pa.array(np.array(content, np.uint64).view(np.int64), pa.int64())],
            names=["id", "hv", "avg_l", "avg_a", "avg_b", "saturation", "edge", "vec", "content"],
        )


def comparable_images(images: DataFrame) -> DataFrame:
    """The comparable images as a written table (COMPARABLE): for each hash value the valid row of smallest id, and every valid
    row whose hash denotes none (a repeated id counts once).

    Copies are dropped where they are read and again before they are shuffled, so a content with a third of all rows moves
    as one row per task. content is a 64-bit digest of the grid and averages. No valid rows, an empty table.
    """
    base = images.select(
        F.col("id").cast("bigint").alias("id"), hash_key(F.col("file_hash")).alias("hv"), F.col("avg_l").cast("double"), F.col("avg_a").cast("double"), F.col("avg_b").cast("double"),
        F.col("saturation").cast("double"), F.col("edge_density").cast("double").alias("edge"), F.col("grid4x4").cast("array<float>"),
    ).where("id IS NOT NULL AND avg_l IS NOT NULL AND avg_a IS NOT NULL AND avg_b IS NOT NULL AND saturation IS NOT NULL AND edge IS NOT NULL AND grid4x4 IS NOT NULL")
    valid = base.mapInArrow(_valid_rows, COMPARABLE)
    rest = [c for c in valid.columns if c not in ("id", "hv")]
    kept = valid.groupBy("hv", F.when(F.col("hv").isNull(), F.col("id")).alias("lone")).agg(F.min("id").alias("id"), F.min_by(F.struct(*rest), "id").alias("r"))
    return cut(kept.select("id", "hv", *[f"r.{c}" for c in rest]))


def bounded_sample(comparable: DataFrame, bound: int, columns: list[str]) -> pa.Table:
    """At most `bound` rows, chosen by a hash of the id, as an Arrow table on the driver (bound x about 800 bytes)."""
    n = comparable.count()
    share = min(1.0, 1.1 * bound / max(n, 1))
    picked = comparable.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return picked.select(*columns).orderBy(F.xxhash64(F.lit(12), "id")).limit(bound).toArrow() if n > bound else comparable.select(*columns).toArrow()


def vectors_of(t: pa.Table | pa.RecordBatch, name: str = "vec") -> np.ndarray:
    col = t.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], pa.binary())
    return unpack(col)


def by_group(batches: Iterator[pa.RecordBatch], key: str, run: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls run for each group of consecutive rows with equal key (BIGINT); only one group is held."""
    held: list[pa.RecordBatch] = []
    current = None
    for b in batches:
        keys = column(b, key).to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
        for s, e in zip(starts, [*starts[1:], len(keys)]):
            if held and keys[s] != current:
                yield from run(pa.Table.from_batches(held))
                held = []
            current = keys[s]
            held.append(b.slice(s, e - s))
    if held:
        yield from run(pa.Table.from_batches(held))
