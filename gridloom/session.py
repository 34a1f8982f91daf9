"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: list[str] = []


def build_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gridloom")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, but only on one machine (tests);
    on a cluster that would be a folder of the driver alone, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        _own_folders.append(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@atexit.register
def _drop_own_folders() -> None:
    for folder in _own_folders:
        shutil.rmtree(folder, ignore_errors=True)


#: Ask the driver to collect garbage after each written table, unless this setting of the session is false.
COLLECT = "gridloom.collectGarbage"


def cut(df: DataFrame) -> DataFrame:
    """Write df to a Parquet table in the shared folder and read it back: the lineage ends there and survives lost executors.

    What fed the table is no longer needed, but Spark drops its shuffle files only when the driver collects garbage, which a
    driver with little to do seldom does; so it is asked to, unless the session's setting COLLECT is false. Tables stay until
    drop_cuts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _cuts.append((spark, path))
    del df
    if spark.conf.get(COLLECT, "true").lower() == "true":
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


_cuts: list[tuple[SparkSession, str]] = []


def drop_cuts() -> int:
    """Deletes the tables cut so far by this process; call it when the results read from them are done with."""
    dropped = 0
    while _cuts:
        spark, path = _cuts.pop()
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        dropped += bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True))
    return dropped


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is read from fewer files than there are cores (small tables); others stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
