"""A live tick feed as a streaming source: an append-only folder per symbol, read by arrival number.

The offset of a reader is the last arrival number of every symbol it was given, kept in the reader's own checkpoint, so
any number of readers go over one feed at their own pace and each gets a tick once. A batch is the next ``limit`` ticks in
arrival order over all symbols; the limit may change between batches (see ``sinks.AdmissionControl``), and what is not
admitted waits in the feed. Only footers, and the arrival numbers of the next batch where there is a limit, are read while
a batch is planned; its ticks are read by the tasks, one per file and row group. Row groups are small, so a batch reads
little beyond its own ticks.

A reader that lags far behind may take several admissions of ``limit`` ticks in one micro-batch (option ``admissions``);
each tick then has the number of its admission, and nothing but the number of micro-batches changes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_json_string

NAME = "tickloom_feed"
ADMISSION = "admission"
GROUP_ROWS = 1 << 16


def append(ticks: DataFrame, folder: str) -> None:
    """Add ticks (symbol, seq, …) to a feed. Arrival numbers of a symbol must be above those the feed has of it."""
    parts = ticks.hint("rebalance", "symbol").sortWithinPartitions("symbol", "seq")
    parts.write.mode("append").option("parquet.block.row.count.limit", GROUP_ROWS).partitionBy("symbol").parquet(folder)


@dataclass(frozen=True)
class Group:
    """A row group of a feed file and its range of arrival numbers."""

    path: str
    number: int
    low: int
    high: int


class Piece(InputPartition):
    def __init__(self, symbol: str, path: str, number: int, after: int, upto: int, first: int, ends: list[int]) -> None:
        self.symbol, self.path, self.number, self.after, self.upto = symbol, path, number, after, upto
        self.first, self.ends = first, ends  # the first admission's number and the symbol's last tick of each


def _opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return pyarrow.fs.LocalFileSystem(), folder


class FeedReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.folder = schema, options["path"]
        self.limit = int(options["limit"]) if "limit" in options else None
        # Where the reader notes what it has asked for, and where a changed limit is looked up. Python names no checkpoint
        # to a source, so the caller gives each reader a folder of its own.
        self.own = options.get("reader")
        if self.limit is not None and (self.limit < 1 or not self.own):
            raise ValueError("a limit must be positive and needs option 'reader', a folder of this reader's own")
        self.together = int(options["admissions"]) if "admissions" in options else None
        if self.together is not None and (self.together < 1 or self.limit is None):
            raise ValueError("admissions must be positive and need a limit")
        self.numbers: dict[tuple[str, int], np.ndarray] = {}
        self.known: dict[str, tuple[str, list[Group]]] = {}
        self.asked: dict | None = None

    # -- what there is ------------------------------------------------------

    def _groups(self) -> dict[str, list[Group]]:
        """Row groups by symbol, in order of arrival; footers of files seen before are not read again."""
        files, root = _opened(self.folder)
        found = files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in found:
            if info.is_file and info.path.endswith(".parquet") and info.path not in self.known:
                symbol = unquote(info.path.rsplit("symbol=", 1)[1].split("/", 1)[0])
                with files.open_input_file(info.path) as f:
                    meta = pq.ParquetFile(f).metadata
                at = meta.schema.names.index("seq")
                groups = []
                for g in range(meta.num_row_groups):
                    numbers = meta.row_group(g).column(at).statistics
                    if numbers is not None and numbers.has_min_max:
                        groups.append(Group(info.path, g, numbers.min, numbers.max))
                self.known[info.path] = (symbol, groups)
        out: dict[str, list[Group]] = {}
        for symbol, groups in self.known.values():
            out.setdefault(symbol, []).extend(groups)
        return {symbol: sorted(groups, key=lambda g: (g.low, g.high)) for symbol, groups in out.items()}

    def _arrivals(self, g: Group) -> np.ndarray:
        if (g.path, g.number) not in self.numbers:
            files, _ = _opened(self.folder)
            with files.open_input_file(g.path) as f:
                self.numbers[g.path, g.number] = np.sort(pq.ParquetFile(f).read_row_group(g.number, ["seq"]).column(0).drop_null().to_numpy())
        return self.numbers[g.path, g.number]

    def _following(self, after: dict[str, int], rows: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The next ``rows`` arrival numbers over all symbols and whose they are; row groups are read as far as needed."""
        held = self._groups()
        names = sorted(held)
        waiting = [(g.low, i, g) for i, s in enumerate(names) for g in held[s] if g.high > after.get(s, -1)]
        waiting.sort(key=lambda w: (w[0], w[1]))
        current = {(g.path, g.number) for _, _, g in waiting}
        self.numbers = {place: seqs for place, seqs in self.numbers.items() if place in current}
        seqs, whose = [], []
        for low, i, g in waiting:
            # what comes before all groups that are not read yet
            if sum(int(np.searchsorted(have, low)) for have in seqs) >= rows:
                break
            some = self._arrivals(g)
            some = some[np.searchsorted(some, after.get(names[i], -1), side="right") :]
            seqs.append(some)
            whose.append(np.full(len(some), i))
        if not seqs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), names
        seq, symbol = np.concatenate(seqs), np.concatenate(whose)
        first = np.lexsort((symbol, seq))[:rows]
        return seq[first], symbol[first], names

    # -- offsets ------------------------------------------------------------

    def _note(self, name: str) -> str:
        return f"{_opened(self.own)[1]}/{name}"

    def _read_note(self, name: str) -> dict | None:
        files, path = _opened(self.own)[0], self._note(name)
        if files.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def _admitted(self) -> int:
        """The limit as of now."""
        noted = self._read_note("limit.json")
        return max(1, int(noted["limit"])) if noted else self.limit

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        groups = self._groups()
        if self.limit is None:
            return {symbol: max(g.high for g in held) for symbol, held in groups.items() if held}
        if self.asked is None:  # a query that is started again goes on behind what it has asked for
            self.asked = self._read_note("asked.json") or {}
        before = self._given(self.asked)
        admitted = self._admitted()
        seq, symbol, names = self._following(before, admitted * (self.together or 1))
        if not len(seq):
            return json.loads(json.dumps(self.asked))
        taken = before | {names[i]: int(seq[symbol == i][-1]) for i in np.unique(symbol).tolist()}
        if self.together is not None:
            lasts = [*range(admitted - 1, len(seq) - 1, admitted), len(seq) - 1]
            first = self.asked.get("first", 0) + len(self.asked.get("ends", ()))
            taken = {"given": taken, "first": first, "ends": [[int(seq[k]), names[symbol[k]]] for k in lasts]}
        if taken != self.asked:
            files, path = _opened(self.own)[0], self._note("asked.json")
            files.create_dir(_opened(self.own)[1], recursive=True)
            with files.open_output_stream(path + ".new") as f:
                f.write(json.dumps(taken).encode())
            files.move(path + ".new", path)
            self.asked = taken
        return dict(taken)

    def _given(self, offset: dict) -> dict[str, int]:
        """The last tick of every symbol; an offset with admissions also has their ends."""
        return offset if self.together is None else offset.get("given", {})

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        first, ends = (0, []) if self.together is None else (end.get("first", 0), end.get("ends", []))
        start, end = self._given(start), self._given(end)
        for symbol, held in self._groups().items():
            after, upto = start.get(symbol, -1), end.get(symbol, -1)
            mine = [seq if symbol <= last else seq - 1 for seq, last in ends]
            pieces += [Piece(symbol, g.path, g.number, after, upto, first, mine) for g in held if g.high > after and g.low <= upto]
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        files, _ = _opened(self.folder)
        layout = to_arrow_schema(self.schema)
        with files.open_input_file(partition.path) as f:
            table = pq.ParquetFile(f).read_row_group(partition.number, [n for n in layout.names if n not in ("symbol", ADMISSION)])
        seq = table.column("seq")
        table = table.filter(pa.compute.and_(pa.compute.greater(seq, partition.after), pa.compute.less_equal(seq, partition.upto)))
        table = table.append_column("symbol", pa.array([partition.symbol] * table.num_rows, pa.string()))
        if self.together is not None:
            number = partition.first + np.searchsorted(partition.ends, table.column("seq").to_numpy())
            table = table.append_column(ADMISSION, pa.array(number, pa.int64()))
        yield from table.select(layout.names).cast(layout).to_batches()

    def commit(self, end: dict) -> None:
        """Nothing is kept for a reader but its offsets."""


class Feed(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return _parse_datatype_json_string(self.options["layout"])

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(schema, dict(self.options))


def read_feed(
    spark: SparkSession, folder: str, schema: StructType, reader: str | None = None, limit: int | None = None, admissions: int | None = None
) -> DataFrame:
    """A stream of the feed's ticks in arrival order; ``limit`` ticks a batch at most, for which ``reader`` names a folder
    of this reader's own (next to its checkpoint). With ``admissions`` a micro-batch holds up to that many admissions of
    ``limit`` ticks, and the stream has the number of each tick's ``admission`` as a further column."""
    spark.dataSource.register(Feed)
    if admissions is not None:
        schema = StructType([*schema.fields, StructField(ADMISSION, LongType())])
    stream = spark.readStream.format(NAME).option("layout", schema.json())
    if limit is not None:
        stream = stream.option("limit", limit).option("reader", reader)
    if admissions is not None:
        stream = stream.option("admissions", admissions)
    return stream.load(folder).select(*[F.col(f.name) for f in schema.fields])
