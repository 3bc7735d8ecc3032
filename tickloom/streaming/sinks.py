"""Sinks, listeners and runners for tick and bar streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tickloom.session import shared_folder


def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one stream's output and checkpoint."""
    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def write_bars(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each finished row once. The checkpoint is the reader's cursor: a restarted
    query continues after the last committed file, so a tick is delivered once."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def dropped_rows(query: StreamingQuery) -> int:
    """Rows a query dropped because they came behind its watermark."""
    return sum(
        state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators
    )


# Batches one after the other, as long as a source that admits a limited number of rows has more.
_ON = {"processingTime": "0 seconds"}


def until_idle(query: StreamingQuery) -> None:
    """Let a query go on until its source has nothing new and its watermark closes nothing more, then stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything there is now and read back its output."""
    spark = stream.sparkSession
    until_idle(write_bars(stream, f"{folder}/out", f"{folder}/checkpoint", _ON))
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_updates(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream over everything there is now; the latest version of each row.

    Every batch is written under its number, so a batch that is run again
    replaces its own rows.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**_ON)
        .foreachBatch(keep)
        .start()
    )
    until_idle(query)
    versions = spark.read.parquet(f"{folder}/out")
    values = [c for c in stream.columns if c not in keys]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("row"))
    return newest.select(*keys, *[F.col(f"row.{c}").alias(c) for c in values])


def notify(
    stream: DataFrame,
    checkpoint: str,
    on_rows: Callable[[DataFrame, int], None],
    on_error: Callable[[Exception, int], None] | None = None,
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Call ``on_rows(frame, batch)`` with every micro-batch as a DataFrame.

    ``on_error`` sees the exception first; the batch still fails and is retried
    after a restart, so a listener cannot lose rows.
    """

    def call(batch: DataFrame, number: int) -> None:
        try:
            on_rows(batch, number)
        except Exception as error:
            if on_error:
                on_error(error, number)
            raise

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(call)
        .start()
    )


def deliver(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream until its source has nothing new; its rows with the number of the ``batch`` that brought them.

    For sources that admit a limited number of rows per batch, which is more than one trigger. Every batch is written
    under its number, so a batch that is run again replaces its own rows. Of a feed that brings several admissions in a
    micro-batch, ``batch`` is the number of the ``admission``.
    """
    spark = stream.sparkSession
    several = "admission" in stream.columns

    def keep(batch: DataFrame, number: int) -> None:
        name = "micro_batch" if several else "batch"
        batch.write.mode("overwrite").parquet(f"{folder}/out/{name}={number}")

    until_idle(stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).start())
    if several:
        rows = spark.read.schema(stream.schema).parquet(f"{folder}/out")
        return rows.select(*[c for c in stream.columns if c != "admission"], F.col("admission").alias("batch"))
    layout = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(layout).parquet(f"{folder}/out")


class AdmissionControl(StreamingQueryListener):
    """Sets the limit of a feed's reader after each micro-batch by how much of ``seconds`` the batch took.

    From a load of 0.8, 0.9 and 1.0 on, the next batches are three quarters, half and a quarter as large; below, they
    grow by a quarter, up to ``most``. Nothing is dropped: what is not admitted stays in the feed. ``history`` has a row
    per batch: its number, rows, load and the limit after it.
    """

    STEPS = ((1.0, 0.25), (0.9, 0.5), (0.8, 0.75))

    def __init__(self, spark: SparkSession, reader: str, most: int, seconds: float = 1.0, least: int = 1) -> None:
        self.spark, self.reader, self.most, self.least, self.seconds = spark, reader, most, least, seconds
        self.limit = most
        self.history: list[tuple[int, int, float, int]] = []

    def after(self, limit: int, load: float) -> int:
        factor = next((f for level, f in self.STEPS if load >= level), 1.25)
        return max(self.least, min(self.most, int(limit * factor)))

    def note(self, batch: int, rows: int, load: float) -> None:
        self.limit = self.after(self.limit, load)
        self.history.append((batch, rows, load, self.limit))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.reader}/limit.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(f'{{"limit": {self.limit}}}'.encode()))
        out.close()

    def metrics(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, "batch long, rows long, load double, limit long")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.numInputRows:
            self.note(progress.batchId, progress.numInputRows, progress.durationMs["triggerExecution"] / 1000 / self.seconds)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Backpressure(StreamingQueryListener):
    """Compares input and processing rate after each micro-batch and reports when the query
    falls behind. It only reports; ``AdmissionControl`` acts."""

    def __init__(self, report: Callable[[str, float], None], levels: tuple[float, ...] = (0.8, 0.9, 1.0)):
        self.report, self.levels = report, sorted(levels)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.inputRowsPerSecond and progress.processedRowsPerSecond:
            load = progress.inputRowsPerSecond / progress.processedRowsPerSecond
            reached = [x for x in self.levels if load >= x]
            if reached:
                self.report(str(progress.id), load)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.report(str(event.id), float("inf"))
