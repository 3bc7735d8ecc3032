"""Session settings the library is written for."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Query-time settings; safe to set on a session somebody else created.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole documents travel in these batches: few at a time bound the memory of a Python worker
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Applications whose workers have been given the package.
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they run: once per application, through Spark's file server."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else the package itself was loaded from a shipped archive
        archive = Path(tempfile.mkdtemp(prefix=f"{root.name}-")).resolve() / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder iterative and streaming jobs keep their tables in.

    A cluster names it in ``spark.checkpoint.dir``; the temporary folder is for
    local mode only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = os.path.join(tempfile.gettempdir(), "tickloom-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


# Tables that this process has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def remove_written(spark: SparkSession) -> int:
    """Delete the tables ``written`` has made for this application; returns how many.

    Results are lazy and read those tables: call it when all results are collected
    or saved. Nothing is removed otherwise.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    hadoop = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    return len(paths)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage, survives lost executors, and gives the planner the true
    size, so a small table is broadcast because it is small. The table stays until
    ``remove_written``. ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)
