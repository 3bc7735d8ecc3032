"""Frames saved under keys such as ``tick/USDJPY/2025-01-17``, in immutable versions.

A save writes its rows to a folder of its own, a *version*, and then publishes a manifest: rows that name, per key, the
version that holds it, with metadata and the time of saving. Manifests of a kind are numbered; one appears by one rename
that fails where the number is taken, so a save is seen whole or not at all, whether it holds one key or all keys of a
kind, and two writers cannot lose each other's. What a reader has opened stays as it was: versions are never changed, only
removed by ``vacuum``. A key's state is its newest manifest row; listing and deleting touch manifests, never rows.
"""

from __future__ import annotations

import fnmatch
import time
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_META = T.StructType(
    [
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("saved_at", T.TimestampType()),
    ]
)
_MANIFEST = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("version", T.StringType()),
        T.StructField("data_type", T.StringType()),
        *_META.fields,
        T.StructField("deleted", T.BooleanType()),
    ]
)


class KeyNotFound(KeyError):
    """No data is stored under the key."""


def split_key(key: str) -> tuple[str, str, str]:
    parts = key.split("/")
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"key {key!r} is not kind/symbol/date")
    return parts[0], parts[1], parts[2]


class KeyedStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- folders ------------------------------------------------------------

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs().listStatus(path)] if self._fs().exists(path) else []

    def _escaped(self, value: str) -> str:
        """A partition value as Spark writes it in directory names."""
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)

    def _rename(self, source: str, target: str) -> bool:
        """Rename a folder in one step; False where the target exists already."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        path = self._fs().makeQualified(self._path(target))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._path(source), path, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    # -- manifests ----------------------------------------------------------

    @staticmethod
    def _new_version() -> str:
        return f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:12]}"

    def _entries(self, kind: str) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self._names(f"{self.root}/log/{kind}") if n.startswith("entry="))

    def _publish(self, kind: str, manifest: DataFrame) -> int:
        """Make the rows of ``manifest`` the newest of the kind; returns their number."""
        log = f"{self.root}/log/{kind}"
        draft = f"{log}/_draft-{uuid.uuid4().hex}"  # not seen by readers
        manifest.select(*_MANIFEST.fieldNames()).coalesce(1).write.parquet(draft)
        number = max(self._entries(kind), default=0) + 1
        while not self._rename(draft, f"{log}/entry={number:012d}"):
            number += 1
        return number

    def _row(self, key: str, version: str | None, data_type: str | None, metadata: Mapping[str, str] | None) -> DataFrame:
        _, symbol, date = split_key(key)
        kept = T.StructType([f for f in _MANIFEST.fields if f.name not in ("date", "saved_at")])
        row = self.spark.createDataFrame([(symbol, version, data_type, dict(metadata or {}), version is None)], kept)
        return row.withColumns({"date": F.lit(date).cast("date"), "saved_at": F.current_timestamp()})

    def manifest(self, kind: str) -> DataFrame:
        """The newest manifest row of each key that is not deleted."""
        if not self._entries(kind):
            return self.spark.createDataFrame([], _MANIFEST)
        layout = T.StructType([*_MANIFEST.fields, T.StructField("entry", T.LongType())])
        log = self.spark.read.schema(layout).parquet(f"{self.root}/log/{kind}")
        values = [f.name for f in _MANIFEST.fields if f.name not in ("symbol", "date")]
        newest = log.groupBy("symbol", "date").agg(F.max_by(F.struct(*values), "entry").alias("row"))
        return newest.select("symbol", "date", "row.*").filter(~F.col("deleted"))

    def _held(self, key: str) -> Row:
        kind, symbol, date = split_key(key)
        mine = self.manifest(kind).filter((F.col("symbol") == symbol) & (F.col("date") == F.lit(date).cast("date")))
        row = mine.first()
        if row is None:
            raise KeyNotFound(key)
        return row

    # -- rows ---------------------------------------------------------------

    def save_data(
        self, data, key: str, metadata: Mapping[str, str] | None = None, schema=None, data_type: str | None = None
    ) -> None:
        """Replace what is stored under ``key``, rows and metadata together. ``data`` is a frame, or records with a schema.

        ``data_type`` (the key's kind by default) is what ``load_data`` may ask for.
        Rows of another symbol than the key's are an error.
        """
        df = data if isinstance(data, DataFrame) else self.spark.createDataFrame(data, schema)
        kind, symbol, date = split_key(key)
        if "symbol" in df.columns and not df.filter(~F.col("symbol").eqNullSafe(symbol)).isEmpty():
            raise ValueError(f"rows of another symbol under the key {key!r}")
        version = self._new_version()
        # symbol and date live in the directory names
        df.drop("symbol", "date").write.parquet(self._dir(kind, version, symbol, date))
        self._publish(kind, self._row(key, version, data_type or kind, metadata))

    def save_partitioned(self, df: DataFrame, kind: str, date: str = "ts") -> None:
        """Save many keys in one job and publish them together: one partition per symbol and day of ``date``.

        The rebalance hint groups a partition's rows into few files and splits a
        hot symbol's day over several tasks.
        """
        version = self._new_version()
        parts = df.withColumn("date", F.to_date(date))
        parts.hint("rebalance", "symbol", "date").write.partitionBy("symbol", "date").parquet(f"{self.root}/data/{kind}/version={version}")
        layout = T.StructType([f for f in _MANIFEST.fields if f.name in ("symbol", "date")])
        # names of directories only; a save without rows has none
        keys = self.spark.read.schema(layout).parquet(f"{self.root}/data/{kind}/version={version}").distinct()
        row = {"version": F.lit(version), "data_type": F.lit(kind), "metadata": F.create_map().cast("map<string,string>")}
        self._publish(kind, keys.withColumns(row | {"saved_at": F.current_timestamp(), "deleted": F.lit(False)}))

    def _dir(self, kind: str, version: str, symbol: str, date: str) -> str:
        return f"{self.root}/data/{kind}/version={version}/symbol={self._escaped(symbol)}/date={self._escaped(date)}"

    def load_data(self, key: str, data_type: str | None = None) -> DataFrame:
        """Rows of a key as of now: a later save does not change them. With ``data_type``, another type is an error."""
        kind, symbol, date = split_key(key)
        held = self._held(key)
        if data_type is not None and held["data_type"] != data_type:
            raise ValueError(f"{key!r} holds {held['data_type']!r}, not {data_type!r}")
        return self.spark.read.parquet(self._dir(kind, held["version"], symbol, date)).withColumns(
            {"symbol": F.lit(symbol), "date": F.lit(date).cast("date")}
        )

    def load_metadata(self, key: str) -> DataFrame:
        held = self._held(key)
        return self.spark.createDataFrame([(held["metadata"], held["saved_at"])], _META)

    def delete_data(self, key: str) -> None:
        self._held(key)
        self._publish(split_key(key)[0], self._row(key, None, None, None))

    def vacuum(self, kind: str) -> int:
        """Remove versions that no key of the kind is in any more, and replace its manifests by one.

        For times without readers or writers of the kind. Returns the number of
        versions removed. The names of versions and manifests are read on the driver.
        """
        held = self.manifest(kind).select("version").distinct()
        last = self._publish(kind, self.manifest(kind))
        used = {r["version"] for r in held.collect()}
        for number in self._entries(kind):
            if number < last:
                self._fs().delete(self._path(f"{self.root}/log/{kind}/entry={number:012d}"), True)
        old = [n for n in self._names(f"{self.root}/data/{kind}") if n.partition("=")[2] not in used]
        for name in old:
            self._fs().delete(self._path(f"{self.root}/data/{kind}/{name}"), True)
        return len(old)

    # -- whole table --------------------------------------------------------

    def table(self, kind: str) -> DataFrame:
        """All keys of a kind as one partitioned frame; a symbol is text, whatever it looks like.

        Only folders that the manifest names are read: their version is joined as a partition column.
        """
        path = f"{self.root}/data/{kind}"
        stored = self.spark.read.parquet(path).schema
        parts = {"version": T.StringType(), "symbol": T.StringType(), "date": T.DateType()}
        typed = [T.StructField(f.name, parts.get(f.name, f.dataType)) for f in stored.fields]
        rows = self.spark.read.schema(T.StructType(typed)).parquet(path)
        held = self.manifest(kind).select("version", F.col("symbol").alias("__symbol"), F.col("date").alias("__date"))
        same = F.col("symbol").eqNullSafe(F.col("__symbol")) & F.col("date").eqNullSafe(F.col("__date"))
        return rows.join(held.withColumnRenamed("version", "__version"), (F.col("version") == F.col("__version")) & same, "left_semi").drop("version")

    def query_data(self, query: str, params: Mapping[str, object] | None = None) -> DataFrame:
        """Run SQL over the stored kinds, each a view of its own name, with named parameters."""
        for kind in self._kinds():
            self.table(kind).createOrReplaceTempView(kind)
        return self.spark.sql(query, args=dict(params or {}))

    def _kinds(self) -> list[str]:
        return sorted(self._names(f"{self.root}/log"))

    def list_keys(self, pattern: str = "*/*/*") -> DataFrame:
        """Keys that match a glob such as ``tick/USDJPY/*``, one per row in column ``key``.

        Spark finds them in the manifests; only the names of kinds are read on the driver.
        """
        kind, *globs = split_key(pattern)
        keys = self.spark.createDataFrame([], "key string")
        for name in fnmatch.filter(self._kinds(), kind):
            parts = self.manifest(name).select("symbol", F.col("date").cast("string").alias("date"))
            for column, glob in zip(("symbol", "date"), globs, strict=True):
                if glob != "*":
                    parts = parts.filter(F.col(column).rlike(f"^{fnmatch.translate(glob)}"))
            keys = keys.unionAll(parts.select(F.concat_ws("/", F.lit(name), "symbol", "date").alias("key")))
        return keys
