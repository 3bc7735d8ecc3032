"""Links between embeddings of high cosine by pigeonholes in subspaces.

Unit vectors of cosine c lie at squared distance 2 - 2c. Vectors are turned by a fixed rotation and split into blocks of
few dimensions: in one block at least, the squared distance is within the block's share of that budget, in proportion to its
dimensions. Each block is a range join of its own: space is cut into cells at medians of a bounded sample, a vector goes
to its own cell and to all cells within the block's radius, and every two cells that may hold neighbours meet in one task
of bounded size. What a block finds is checked exactly, and a pair counts in the first block whose share it keeps, so no
list of pairs is made, sent or deduplicated: a task returns, per vector, how many vectors it is linked with and one vector
of its component. Equal vectors are one class from the start.

Cells only save work where vectors differ in density (clusters, few real dimensions). Where a block is as wide in every
direction as its radius, every two cells meet, and work grows with the square of the vectors, over a large cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import LAST_ID
from tickloom.llm.components import components
from tickloom.session import written

WIDTH = 16  # dimensions of a block
CELL = 65_536  # vectors of a cell, about
SAMPLE = 20_000  # vectors at most that cells are cut by; the result does not depend on them
KINDS = 100  # vector lengths, the most frequent ones, whose cells are cut; each other length is one cell
SLACK, LOOSE = 1e-9, 1e-5  # relative in double precision, absolute in single precision


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by a power of two, which changes no cosine and keeps squares finite, and their lengths."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Vectors filled up to a power of two and turned: fixed signs, then sums and differences at doubling distance, twice.

    Only sums of two numbers, so that a vector gives the same bits in whatever batch it comes.
    """
    n, dims = vectors.shape
    size = 1 << max(0, dims - 1).bit_length()
    out = np.zeros((n, size))
    out[:, :dims] = vectors
    for seed in (1, 2):
        out *= np.random.default_rng(seed).integers(0, 2, size) * 2.0 - 1.0
        half = 1
        while half < size:
            pairs = out.reshape(n, -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
            half *= 2
    return out / size


def blocks_of(turned: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Rotated vectors as rows of blocks: (vectors, blocks, dimensions of a block)."""
    return turned.reshape(len(turned), -1, min(width, turned.shape[1]))


class Cells:
    """Boxes of one block, cut at medians of a sample in the widest direction until there are ``2 ** depth``."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        dims = sample.shape[1]
        boxes = [(np.full(dims, -np.inf), np.full(dims, np.inf), sample)]
        for _ in range(depth):
            halves = []
            for low, high, rows in boxes:
                k = int(np.ptp(rows, axis=0).argmax()) if len(rows) else 0
                cut = float(np.median(rows[:, k])) if len(rows) else float(np.clip(0.0, low[k], high[k]))
                under, over = high.copy(), low.copy()
                under[k] = over[k] = cut
                halves += [(low, under, rows[rows[:, k] < cut]), (over, high, rows[rows[:, k] >= cut])]
            boxes = halves
        self.low, self.high = np.stack([b[0] for b in boxes]), np.stack([b[1] for b in boxes])

    def near(self, points: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """Each point's own cell, and whether each cell is within the squared distance ``budget``."""
        apart = np.zeros((len(points), len(self.low)))
        inside = np.ones(apart.shape, bool)
        for k in range(points.shape[1]):
            x, low, high = points[:, k, None], self.low[:, k], self.high[:, k]
            inside &= (x >= low) & (x < high)
            apart += np.maximum(np.maximum(low - x, x - high), 0.0) ** 2
        return inside.argmax(axis=1), apart <= budget * (1 + SLACK)


def _unpacked(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), dims)


_SENT = "dims int, block int, low int, high int, first boolean, class long, copies long, vector binary"


def _sent(cells: dict[int, list[Cells]], cosine: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``dims, class, copies, vector`` once for every two cells that the vector has to be met in."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SENT.split(", ")]
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            for dims in np.unique(lengths).tolist():
                rows = batch.filter(pa.array(lengths == dims))
                scaled, norm = unit(_unpacked(rows.column(3), dims))
                blocks = blocks_of(rotated(scaled / norm[:, None]))
                n, count = len(norm), blocks.shape[1]
                for block in range(count):
                    own, near = np.zeros(n, np.int64), np.ones((n, 1), bool)
                    if dims in cells:
                        own, near = cells[dims][block].near(blocks[:, block], (2 - 2 * cosine) / count)
                    at, other = np.nonzero(near)
                    mine = own[at]
                    low, high = np.minimum(mine, other), np.maximum(mine, other)
                    constant = [pa.array(np.full(len(at), v), pa.int32()) for v in (dims, block)]
                    ends = [pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(mine == low, pa.bool_())]
                    columns = [*constant, *ends, *(rows.column(k).take(pa.array(at)) for k in (1, 2, 3))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return send


class _Meeting:
    """The vectors of two cells of a block, or of one."""

    def __init__(self, table: pa.Table, cosine: float) -> None:
        dims = table.column("dims")[0].as_py()
        self.block, self.cosine = table.column("block")[0].as_py(), cosine
        self.ids = table.column("class").to_numpy()
        self.copies = table.column("copies").to_numpy().astype(np.float64)
        self.first = table.column("first").to_numpy(zero_copy_only=False)
        self.scaled, self.norm = unit(_unpacked(table.column("vector"), dims))
        self.units = self.scaled / self.norm[:, None]
        self.parts = blocks_of(rotated(self.units))
        self.budget = (2 - 2 * cosine) / self.parts.shape[1]
        self.links = np.zeros(len(self.ids))
        self.root = np.arange(len(self.ids))

    def _sides(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Single-precision rows whose product is minus half of the squared distance in a block."""
        part = self.parts[:, block]
        half, one = -(part * part).sum(axis=1)[:, None] / 2, np.ones((len(part), 1))
        return np.hstack([part, half, one]).astype("f4"), np.hstack([part, one, half]).astype("f4")

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            x, y = root[i], root[j]
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low != high
            i, j = i[apart], j[apart]
            np.minimum.at(root, high[apart], low[apart])
            while (root[root] != root).any():
                root[:] = root[root]

    def _exact(self, i: np.ndarray, j: np.ndarray, step: int = 16_384) -> None:
        """Count those pairs that have the cosine and whose first block within its share is this one."""
        for at in range(0, len(i), step):
            a, b = i[at : at + step], j[at : at + step]
            within = ((self.parts[a] - self.parts[b]) ** 2).sum(axis=2) <= self.budget * (1 + SLACK)
            mine = within[:, self.block] & ~within[:, : self.block].any(axis=1)
            a, b = a[mine], b[mine]
            alike = (self.scaled[a] * self.scaled[b]).sum(axis=1) / (self.norm[a] * self.norm[b]) >= self.cosine
            a, b = a[alike], b[alike]
            np.add.at(self.links, a, self.copies[b])
            np.add.at(self.links, b, self.copies[a])
            self._join(a, b)

    def _many(self, near: np.ndarray, rows: np.ndarray, columns: np.ndarray, left: list, right: list) -> np.ndarray:
        """Count at once the pairs of which single precision leaves no doubt; returns those in doubt."""
        edge = -self.budget / 2
        clear = np.ones_like(near)
        for (x, _), (_, y) in zip(left, right, strict=True):
            before = x[rows] @ y[columns].T
            near &= before < edge + LOOSE  # else it counts in an earlier block
            clear &= before < edge - LOOSE
        alike = self.units[rows] @ self.units[columns].T
        x, y = self._sides_now
        sure = near & clear & (x[rows] @ y[columns].T >= edge + LOOSE) & (alike >= self.cosine + SLACK)
        weight = sure.astype("f8")
        self.links[rows] += weight @ self.copies[columns]
        self.links[columns] += self.copies[rows] @ weight
        i, j = np.nonzero(sure)
        self._join(rows[i], columns[j])
        return near & ~sure & (alike >= self.cosine - SLACK)

    def meet(self, slab: int = 256, width: int = 4096) -> None:
        edge = -self.budget / 2 - LOOSE
        x, y = self._sides_now = self._sides(self.block)
        earlier = [self._sides(k) for k in range(self.block)]
        own = self.first.all()
        left = np.arange(len(self.ids)) if own else np.flatnonzero(self.first)
        right = left if own else np.flatnonzero(~self.first)
        for at in range(0, len(left), slab):
            rows = left[at : at + slab]
            for to in range(at if own else 0, len(right), width):
                columns = right[to : to + width]
                near = x[rows] @ y[columns].T >= edge
                if own and to < at + slab:
                    near &= rows[:, None] < columns
                found = np.count_nonzero(near)
                if found * 50 > near.size:
                    near = self._many(near, rows, columns, earlier, earlier)
                    found = np.count_nonzero(near)
                if found:
                    i, j = np.nonzero(near)
                    self._exact(rows[i], columns[j])


def _met(cosine: float) -> Callable[[pa.Table], pa.Table]:
    def met(table: pa.Table) -> pa.Table:
        own = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        first = table.column("first").to_numpy(zero_copy_only=False)
        if own or first.any() and not first.all():
            meeting = _Meeting(table, cosine)
            meeting.meet()
            some = np.flatnonzero(meeting.links)
            found = [meeting.ids[some], meeting.links[some].astype(np.int64), meeting.ids[meeting.root[some]]]
        else:
            found = [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["class", "links", "root"])

    return met


def _usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, without components that are null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cut(classes: DataFrame, cell: int) -> dict[int, list[Cells]]:
    """Cells of the blocks of each frequent vector length that has more vectors than one cell takes."""
    lengths = classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(KINDS).collect()
    out = {}
    for dims, count in lengths:
        if count <= cell:
            continue
        some = classes.filter((F.col("dims") == dims) & (F.pmod(F.xxhash64("class"), F.lit(max(1, count // SAMPLE))) == 0))
        scaled, norm = unit(_unpacked(some.select("vector").limit(SAMPLE).toArrow().column("vector"), dims))
        blocks = blocks_of(rotated(scaled / norm[:, None]))
        depth = int(np.ceil(np.log2(count / cell)))
        out[dims] = [Cells(blocks[:, k], depth) for k in range(blocks.shape[1])]
    return out


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's lists of doubles as bytes."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        raw = [memoryview(v.values.to_numpy()).tobytes() for v in lists]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], batch.schema.names)


def linked_classes(rows: DataFrame, cosine: float, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Classes ``h1, h2, class, node, copies`` of equal vectors, and rows ``class, links, root`` of what tasks have found.

    ``rows`` has ``vec_id, vector, h1, h2``: usable vectors and two hashes of them.
    """
    grouped = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    grouped = grouped.select("h1", "h2", "node", "copies", F.size("vector").alias("dims"), "vector")
    grouped = grouped.mapInArrow(_packed, "h1 long, h2 long, node long, copies long, dims int, vector binary")
    classes = written(grouped.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    sent = classes.select("dims", "class", "copies", "vector").mapInArrow(_sent(_cut(classes, cell), cosine), _SENT)
    met = sent.groupBy("dims", "block", "low", "high").applyInArrow(_met(cosine), "class long, links long, root long")
    return classes.select("h1", "h2", "class", "node", "copies"), written(met, "vector-links")


def near_vectors(embeddings: DataFrame, cosine: float = 0.9, cell: int = CELL) -> DataFrame:
    """One row per ``vec_id, embedding`` row: ``vec_id, n_links, component_id, kept``.

    Vectors of one length whose cosine in double precision is at least ``cosine`` are linked. n_links is the number of other
    rows that a row is linked with; component_id is the smallest vec_id reachable over links; kept is vec_id =
    component_id. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths are not compared. Repeated rows are linked with each other; rows of one vec_id with different
    vectors share their component, not their links. Rows without a vec_id count as one vector behind all others and get a
    null component_id unless they are linked to a smaller one. Other columns are not read; an empty table gives no rows.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("vec_id"), vector.alias("vector"))
    usable = rows.filter(_usable(F.col("vector")))
    keyed = usable.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    classes, found = linked_classes(keyed, cosine, cell)
    placed = keyed.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"])
    tied = placed.groupBy("vec_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a != b").select("a", "b")
    joined = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")).distinct().unionAll(tied))
    named = joined.join(classes.select(F.col("class").alias("node"), F.col("node").alias("least")), "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = named.join(least, "component").select(F.col("node").alias("class"), "component_id")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    shown = placed.join(reached, "class", "left").join(links, "class", "left")
    shown = shown.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    alone = rows.filter(~_usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    hide = lambda c: F.when(c != LAST_ID, c)
    kept = (F.col("vec_id") == F.col("component_id")).alias("kept")
    return shown.unionAll(alone).select(hide(F.col("vec_id")).alias("vec_id"), "n_links", hide(F.col("component_id")).alias("component_id"), kept)
