"""Nearest-neighbour search over vector tables: exact scans of a stated query block, and an inverted-file index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut

#: Queries handled at once; their vectors are broadcast.
BLOCK = 8192
METRICS = ("l2", "ip", "cosine")


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) and col.num_chunks else col
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Query x row distances; exact for the rows kept, since they are taken again one by one."""
    dot = q @ x.T
    if metric == "l2":
        return (q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * dot
    if metric == "ip":
        return 1 - dot
    norm = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None]
    return 1 - dot / np.where(norm > 0, norm, 1)


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(((q - x) ** 2).sum(1))
    dot = (q * x).sum(1)
    if metric == "ip":
        return 1 - dot
    norm = np.sqrt((q**2).sum(1) * (x**2).sum(1))
    return 1 - dot / np.where(norm > 0, norm, 1)


def scan(rows: DataFrame, queries: DataFrame, metric: str, k: int | None = None, eps: float | None = None, label: str | None = None) -> DataFrame:
    """(q, id, distance[, label]) candidates: each task's k nearest rows of every query, or all rows within eps.

    rows: (id, vec[, label]); queries: (q, vec). Vectors are scanned by all tasks against blocks of BLOCK broadcast queries,
    as matrix products; a query is not its own neighbour. Null and wrongly sized vectors are no rows.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    asked = queries.where("vec IS NOT NULL").select("q", "vec")
    n = asked.count()
    blocks = max(1, -(-n // BLOCK))
    schema = "q bigint, id bigint, distance double" + (f", label {rows.schema[label].dataType.simpleString()}" if label else "")
    cols = ["id", "vec", *([F.col(label).alias("label")] if label else [])]
    made = None
    for i in range(blocks):
        block = (asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) if blocks > 1 else asked).toArrow()
        if not block.num_rows:
            continue
        qs, qx = block.column("q").to_numpy(), _matrix(block.column("vec"))
        shared = rows.sparkSession.sparkContext.broadcast((qs, qx))

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            qs, qx = shared.value
            step = max(64, 6_000_000 // len(qs))
            kept: list[tuple[np.ndarray, ...]] = []
            worst = np.full(len(qs), np.inf)

            def best() -> tuple[np.ndarray, ...]:
                q, ids, d, lab = (np.concatenate(x) for x in zip(*kept))
                o = np.lexsort((ids, d, q))
                q, ids, d, lab = q[o], ids[o], d[o], lab[o]
                start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
                good = nth < k
                full = nth == k - 1
                worst[q[full]] = d[full]
                return q[good], ids[good], d[good], lab[good]

            for whole in batches:
                for s in range(0, len(whole), step):
                    b = whole.slice(s, step)
                    x, ids = _matrix(b.column(1)), b.column(0).to_numpy()
                    lab = b.column(2).to_numpy(zero_copy_only=False) if label else ids
                    rough = _scores(qx, x, metric)
                    limit = np.full(len(qs), np.inf if eps is None else eps) if k is None else worst
                    bound = limit**2 if metric == "l2" else limit
                    if k is not None and len(ids) > k + 1 and not np.isfinite(bound).all():
                        # A query has k rows of this batch at least this near (one more in case it meets itself).
                        bound = np.minimum(bound, np.partition(rough, k, axis=1)[:, k] * (1 + 1e-9) + 1e-9)
                    q, r = np.nonzero(rough <= np.where(np.isfinite(bound), bound, np.inf)[:, None] + 1e-6)
                    keep = qs[q] != ids[r]
                    q, r = q[keep], r[keep]
                    d = np.concatenate([_exact(qx[q[t : t + 20_000]], x[r[t : t + 20_000]], metric) for t in range(0, len(q), 20_000)]) if len(q) else np.zeros(0)
                    if eps is not None:
                        within = d <= eps
                        q, r, d = q[within], r[within], d[within]
                    if not len(q):
                        continue
                    kept.append((q, ids[r], d, lab[r]))
                    if k is not None:
                        kept[:] = [best()]
                    else:
                        yield _rows(kept.pop())
            if kept:
                yield _rows(kept[0])

        def _rows(t: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            q, ids, d, lab = t
            arrays = [pa.array(qs_[q]), pa.array(ids), pa.array(d)]
            return pa.RecordBatch.from_arrays(arrays + ([pa.array(lab)] if label else []), names=["q", "id", "distance", *(["label"] if label else [])])

        qs_ = qs
        size = qx.shape[1]
        part = rows.where(F.col("vec").isNotNull() & (F.size("vec") == size)).select(*cols).mapInArrow(run, schema)
        made = part if made is None else made.unionByName(part)
    return made if made is not None else rows.sparkSession.createDataFrame([], schema)


def top_k(found: DataFrame, k: int) -> DataFrame:
    """(q, rank, id, distance): the k nearest of all tasks' candidates; equal distances go by id."""
    order = Window.partitionBy("q").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Column | None = None, deleted: str | None = None) -> DataFrame:
    """Exact k nearest rows; `where` filters rows before ranking, `deleted` names a mark of rows to skip."""
    if where is not None:
        rows = rows.where(where)
    if deleted:
        rows = rows.where(~F.coalesce(F.col(deleted), F.lit(False)))
    return top_k(scan(rows, queries, metric, k=k), k)


def within(rows: DataFrame, queries: DataFrame, eps: float, metric: str = "l2", most: int | None = None) -> DataFrame:
    """All rows within eps of a query, at most the `most` nearest if given (the search's stop condition)."""
    if most is None:
        return scan(rows, queries, metric, eps=eps)
    return top_k(scan(rows, queries, metric, k=most, eps=eps), most).drop("rank")


def knn_documents(rows: DataFrame, queries: DataFrame, label: str, documents: int, metric: str = "l2") -> DataFrame:
    """(q, id, distance, label): rows nearer than the first row of the (documents + 1)-th nearest document.

    Documents are ordered by their nearest row. The k nearest rows settle a query as soon as they hold one document more
    than asked for, or all rows; the others are asked again with twice as many, so no query meets all rows at once.
    """
    k = 4 * (documents + 1)
    asked, made = queries, None
    while True:
        found = cut(top_k(scan(rows, asked, metric, k=k, label=label), k))
        firsts = found.groupBy("q", "label").agg(F.min("distance").alias("first"))
        nth = firsts.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("first", "label"))).where(F.col("n") == documents + 1).select("q", F.col("first").alias("stop"))
        full = found.where(F.col("rank") == k).select("q")
        open_ = cut(full.join(nth.select("q"), "q", "left_anti"))
        done = found.join(open_, "q", "left_anti").join(nth, "q", "left").where(F.col("stop").isNull() | (F.col("distance") < F.col("stop"))).drop("stop", "rank")
        made = done if made is None else made.unionByName(done)
        if not open_.take(1):
            return made
        asked = asked.join(open_, "q", "left_semi")
        k *= 2


class CellIndex:
    """Inverted-file index: k-means cells learned from a bounded sample, every row assigned to its nearest cell.

    add/remove/save/load and soft deletion act on the row table; a search probes the nearest cells of each query.
    """

    SAMPLE = 20_000

    def __init__(self, centres: np.ndarray, rows: DataFrame):
        self.centres, self.rows = centres, rows

    @classmethod
    def build(cls, rows: DataFrame, cells: int, rounds: int = 12, seed: int = 100) -> CellIndex:
        sample = _matrix(rows.where("vec IS NOT NULL").select("id", "vec").orderBy(F.xxhash64("id")).limit(cls.SAMPLE).toArrow().column("vec"))
        rng = np.random.default_rng(seed)
        centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)] if len(sample) else np.zeros((1, 1))
        for _ in range(rounds if len(sample) else 0):
            near = _scores(sample, centres, "l2").argmin(1)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = sample[near == c].mean(0)
        return cls(centres, cls._assign(rows, centres))

    @staticmethod
    def _assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = _scores(_matrix(b.column(1)), centres, "l2").argmin(1) if len(b) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=["id", "vec", "cell"])

        return rows.where("vec IS NOT NULL").select("id", "vec").mapInArrow(run, "id bigint, vec array<float>, cell int").withColumn("deleted", F.lit(False))

    def add(self, rows: DataFrame) -> CellIndex:
        """Adds rows, in place of those of equal id."""
        return CellIndex(self.centres, self.rows.join(rows.select("id"), "id", "left_anti").unionByName(self._assign(rows, self.centres)))

    def remove(self, ids: DataFrame) -> CellIndex:
        return CellIndex(self.centres, self.rows.join(ids.select("id"), "id", "left_anti"))

    def mark_deleted(self, ids: DataFrame, deleted: bool = True) -> CellIndex:
        marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
        return CellIndex(self.centres, self.rows.join(marked, "id", "left").withColumn("deleted", F.when(F.col("_hit"), F.lit(deleted)).otherwise(F.col("deleted"))).drop("_hit"))

    def vector(self, ids: DataFrame) -> DataFrame:
        return self.rows.join(ids.select("id"), "id", "left_semi").select("id", "vec")

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(self.centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark, path: str, expected: int | None = None) -> CellIndex:
        """The saved index; ValueError if it doesn't hold the `expected` number of rows, as one made for another library wouldn't."""
        centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
        rows = spark.read.parquet(f"{path}/rows")
        if expected is not None and (held := rows.count()) != expected:
            raise ValueError(f"index holds {held} rows, not {expected}")
        return cls(_matrix(centres.column("centre")), rows)

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(q, rank, id, distance): the k nearest among the rows of each query's `probes` nearest cells; a row of id q is left out.

        A stated set of queries, BLOCK at a time: each task multiplies its rows of a cell with the queries that probe it and
        keeps k rows a query. Rows of a saved index are read by cell, so cells nobody probes are not read."""
        n = queries.count()
        blocks = max(1, -(-n // BLOCK))
        made = None
        for i in range(blocks):
            part = queries.where("vec IS NOT NULL AND q IS NOT NULL").select("q", "vec")
            asked = (part.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) if blocks > 1 else part).toArrow()
            if not len(asked):
                continue
            q, x = asked.column("q").to_numpy(), _matrix(asked.column("vec")).astype(float)
            near = np.argsort(_scores(x, self.centres, "l2"), axis=1, kind="stable")[:, :probes]
            by_cell = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
            shared = self.rows.sparkSession.sparkContext.broadcast((q, x, by_cell))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                q, x, by_cell = shared.value
                norm = (x**2).sum(1)
                none = np.iinfo(np.int64).max
                best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), none)
                for b in batches:
                    if not len(b):
                        continue
                    ids, rows, cells = b.column(0).to_numpy(), _matrix(b.column(1)).astype(float), b.column(2).to_numpy()
                    for c in np.unique(cells):
                        who = by_cell.get(int(c))
                        if who is None:
                            continue
                        mine = np.flatnonzero(cells == c)
                        for s in range(0, len(who), 2048):
                            w = who[s : s + 2048]
                            d = np.sqrt(np.maximum(norm[w, None] + (rows[mine] ** 2).sum(1)[None] - 2 * (x[w] @ rows[mine].T), 0))
                            d[q[w, None] == ids[mine][None]] = np.inf
                            all_d = np.concatenate([best_d[w], d], axis=1)
                            all_i = np.concatenate([best_i[w], np.broadcast_to(ids[mine], d.shape)], axis=1)
                            order = np.lexsort((all_i, all_d))[:, :k]
                            best_d[w], best_i[w] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
                at, n = np.nonzero(np.isfinite(best_d))
                yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(best_i[at, n]), pa.array(best_d[at, n])], names=["q", "id", "distance"])

            live = self.rows.where(~F.col("deleted") & F.col("cell").isin([int(c) for c in by_cell])).select("id", "vec", "cell")
            found = live.mapInArrow(run, "q bigint, id bigint, distance double")
            made = found if made is None else made.unionByName(found)
        if made is None:
            made = self.rows.select(F.col("id").alias("q"), "id", F.lit(0.0).alias("distance")).limit(0)
        return top_k(made, k)
