"""Image folders and SQLite libraries as DataFrames."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The extensions of a library.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def image_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the folder's image files; extensions in any letter case. Paths are sorted by
    the reader of the result where order matters; content is read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*EXTENSIONS))


def image_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(origin, y, x, b, g, r) of decodable images; others are left out. Rows of an image stay in its partition."""
    raw = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*").where("nChannels IN (1, 3, 4)")

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for r in b.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                a = np.repeat(a, 3, axis=2) if r.nChannels == 1 else a[:, :, :3]
                y, x = np.divmod(np.arange(r.height * r.width), r.width)
                p = a.reshape(-1, 3).astype(int)
                yield pd.DataFrame({"origin": r.origin, "y": y, "x": x, "b": p[:, 0], "g": p[:, 1], "r": p[:, 2]})

    return raw.mapInPandas(run, "origin string, y int, x int, b int, g int, r int")


#: Bytes of files hashed side by side.
TABLE = 64 << 20


def content_digests(files: DataFrame) -> DataFrame:
    """(path, length, digest): files with the SHA-256 of their bytes, made in the JVM: the key to tell contents apart by."""
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))


def content_hashes(files: DataFrame) -> DataFrame:
    """(path, length, file_hash): the decimal FNV-1a 64 of the files' bytes, for libraries that hold it. Each byte depends on the
    one before, so it takes a step a byte (of all files of a batch at once); use content_digests where any key will do."""

    def run(batches):
        import numpy as np

        for b in batches:
            sizes = np.array([len(c) for c in b["content"]], np.int64)
            order = np.argsort(-sizes, kind="stable")
            h = np.full(len(b), 0xCBF29CE484222325, np.uint64)
            start = 0
            while start < len(order) and sizes[order[start]]:
                # As many files, longest first, as fit in a table of bytes of bounded size; a step touches the first ones.
                some = order[start : start + max(1, TABLE // int(sizes[order[start]]))]
                start += len(some)
                table = np.zeros((int(sizes[some[0]]), len(some)), np.uint8)
                for at, i in enumerate(some):
                    table[: sizes[i], at] = np.frombuffer(b["content"].iloc[i], np.uint8)
                left = np.searchsorted(-sizes[some], -np.arange(len(table)), side="left")
                state = h[some]
                with np.errstate(over="ignore"):
                    for at, n in enumerate(left):
                        state[:n] = (state[:n] ^ table[at, :n]) * np.uint64(0x100000001B3)
                h[some] = state
            yield b.drop(columns="content").assign(file_hash=[str(int(x)) for x in h])

    return files.select("path", "length", "content").mapInPandas(run, "path string, length bigint, file_hash string")


#: Rows of a SQLite table a task reads.
SLICE = 50_000


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of a SQLite library in a file all tasks can read: each task reads its slices of row ids; the driver only asks for
    the ends of their range."""
    if not name.isidentifier():
        raise ValueError("not a table name")
    columns = [c.split()[0] for c in schema.split(",")]
    address = f"file:{path}?mode=ro"
    with sqlite3.connect(address, uri=True) as db:
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()  # noqa: S608
    if low is None:
        return spark.createDataFrame([], schema)

    def run(batches):
        import pandas as pd

        with sqlite3.connect(address, uri=True) as db:
            for b in batches:
                for start in b["id"]:
                    rows = db.execute(f"SELECT {', '.join(columns)} FROM {name} WHERE rowid >= ? AND rowid < ?", (int(start), int(start) + SLICE)).fetchall()  # noqa: S608
                    yield pd.DataFrame(rows, columns=columns, dtype=object)

    return spark.range(low, high + 1, SLICE).mapInPandas(run, schema)
