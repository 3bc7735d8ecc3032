"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A signature keeps the smallest and the largest value of each permutation, so 88 hash evaluations give 176 values, cut into
44 bands of four, each from four permutations. Two sets of similarity 0.75 agree in a band with probability 0.316, of any
size, and share none with probability 6e-8 (if bands were independent; smallest and largest value of a permutation are
not quite, in small sets). Sets that are equal are one class from
the start. Candidates come in two steps that never list all pairs of a bucket: first every class of a bucket against its
smallest one, in some bands, which joins large groups of near copies; then, inside each bucket of all bands that still holds
several components, all classes of different components: sketches say which may have a link, and those are compared on
their full sets by a product of matrices in the same tasks. What leaves a task are classes and links between components, so
rows stay in proportion. A large bucket (a passage that very many documents share) is cut into parts, and every two parts
meet in a task of bounded size, so that no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import LAST_ID
from tickloom.llm.components import components
from tickloom.llm.shingles import Shingles
from tickloom.session import written

PERMUTATIONS, BANDS, ROWS = 88, 44, 4
MANY = 2048  # classes of a bucket, about, that meet as many others in one task
STAR_BANDS = 8  # bands that join large groups of near copies before all are looked at
# A pair of similarity 0.75 agrees in fewer than 55 % of 176 values with probability under 1e-8.
SURE = 0.55


def _constants() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20240501).integers(0, 2**63, (2, PERMUTATIONS), dtype=np.uint64)
    return (made[0] << np.uint64(1)) | np.uint64(1), made[1]


def signature(shingles: np.ndarray, block: int = 16_384) -> np.ndarray:
    """Smallest, then largest values of all permutations over a non-empty set, upper 32 bits."""
    a, b = _constants()
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), block):
        values = shingles[None, at : at + block] * a[:, None] + b[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return (np.concatenate([low, high]) >> np.uint64(32)).astype("<u4")


def band_rows(values: np.ndarray) -> np.ndarray:
    """The values of each band: smallest of permutations k and 44 + k, largest of 22 + k and 66 + k (modulo 88)."""
    low, high = values[:PERMUTATIONS], np.roll(values[PERMUTATIONS:], -BANDS // 2)
    return np.ascontiguousarray(np.concatenate([low, high]).reshape(ROWS, BANDS).T)


def band_keys(values: np.ndarray) -> list[int]:
    """A 64-bit key per band; the four values of a band come from four permutations."""
    rows = band_rows(values)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) - 2**63 for k, row in enumerate(rows)]


def _signed(docs: DataFrame) -> DataFrame:
    """``doc, n_shingles, h1, h2, sketch, bands``: one row per input row."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                got = shingles.distinct(text.as_py() or "")
                values = signature(got) if len(got) else None
                digest = xxhash.xxh3_128_intdigest(got.tobytes())
                row = (len(got), (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63)
                row += (None, None) if values is None else (values.astype("<u2").tobytes(), band_keys(values))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "n", "h1", "h2", "sketch", "bands"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), "text")
    return rows.mapInArrow(sign, "doc long, n long, h1 long, h2 long, sketch binary, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """``node, set``: the full shingle sets of rows ``node, text``."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            got = [shingles.distinct(t.as_py() or "").view(np.int64) for t in batch.column(1)]
            sets = pa.array(got, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "set"])

    return docs.mapInArrow(make, "node long, set array<long>")


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree often enough to be worth their full sets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
        near = pa.array((x == y).mean(axis=1) >= SURE)
        yield batch.select([0, 1]).filter(near)


class _Checker:
    """Confirms candidate pairs: sizes, then sketches, then full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame) -> None:
        self.classes = classes
        self.texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("node"), "text")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        return written(_sets(self.texts.join(nodes.distinct(), "node", "left_semi")), "near-sets")

    def _side(self, name: str) -> DataFrame:
        return self.classes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs ``a, b`` with 100 * intersection >= 75 * union."""
        sized = pairs.join(self._side("a"), "a").join(self._side("b"), "b")
        sized = sized.filter(100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b"))
        near = written(sized.select("a", "b", "s_a", "s_b").mapInArrow(_alike, "a long, b long").distinct(), "near-pairs")
        sets = self.sets_of(near.select(F.col("a").alias("node")).unionAll(near.select("b")))
        x = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        matched = near.join(x, "a").join(y, "b").withColumn("both", both)
        linked = matched.filter(100 * F.col("both") >= 75 * (F.size("x") + F.size("y") - F.col("both")))
        return written(linked.select("a", "b"), "near-links")


def _by_tile(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Call ``work`` with whole tiles; rows come sorted by tile."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            keys = table.column("tile").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last tile may go on
            for lo, hi in _edges(keys[:cut]):
                yield from work(table.slice(lo, hi - lo))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from work(held)

    return run


def _edges(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
    return list(zip(cuts[:-1], cuts[1:], strict=True))


_MEMBER = "tile long, part long, same boolean, node long, component long"


def _may_link(table: pa.Table, block: int = 64) -> Iterator[pa.RecordBatch]:
    """The members of a tile that have one of another component whose size and sketch allow a link: not the pairs.

    A pair counts in the first band that both share, so that sets are not sent to all buckets that two texts meet in.
    """
    part, node, component, n = (table.column(c).to_numpy() for c in ("part", "node", "component", "n"))
    same = table.column("same").to_numpy(zero_copy_only=False)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u2").reshape(len(node), -1)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    key = table.column("key")[0].as_py()
    wanted = np.zeros(len(node), bool)
    for at in range(0, len(node), block):
        left, right = np.arange(at, min(at + block, len(node))), np.arange(at, len(node))
        size = np.minimum(n[left, None], n[right]) * 100 >= np.maximum(n[left, None], n[right]) * 75
        met = same[left, None] | (part[left, None] != part[right])
        # two members that are both wanted already need no look
        i, j = np.nonzero(size & met & (component[left, None] != component[right]) & ~(wanted[left, None] & wanted[right]))
        i, j = left[i], right[j]
        for k in range(0, len(i), 4096):
            a, b = i[k : k + 4096], j[k : k + 4096]
            near = (sketch[a] == sketch[b]).mean(axis=1) >= SURE
            a, b = a[near], b[near]
            here = bands[a, (bands[a] == bands[b]).argmax(axis=1)] == key
            wanted[a[here]] = wanted[b[here]] = True
    names = [f.split()[0] for f in _MEMBER.split(", ")]
    for batch in table.select(names).filter(pa.array(wanted)).to_batches():
        yield batch


def _joined(table: pa.Table, columns: int = 2048) -> Iterator[pa.RecordBatch]:
    """Links between the components of a tile by the full sets of its members: one per component at most.

    Intersections of all members at once are a product of 0/1 matrices over the shingles that two of them have.
    """
    part, component = table.column("part").to_numpy(), table.column("component").to_numpy()
    same = table.column("same").to_numpy(zero_copy_only=False)
    sets = table.column("set").combine_chunks()
    n = np.diff(sets.offsets.to_numpy())
    owner = np.repeat(np.arange(len(n)), n)
    values, at, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    owner, at = owner[shared[at]], place[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(n), len(n)), np.float32)
    for lo in range(0, int(shared.sum()), columns):
        here = slice(*np.searchsorted(at, [lo, lo + columns]))
        dense = np.zeros((len(n), columns), np.float32)
        dense[owner[here], at[here] - lo] = 1
        both += dense @ dense.T
    linked = 100 * both >= 75 * (n[:, None] + n[None] - both)
    linked &= (same[:, None] | (part[:, None] != part[None])) & (component[:, None] != component[None])
    names, place = np.unique(component, return_inverse=True)
    i, j = np.nonzero(linked)
    root = np.arange(len(names))
    i, j = place[i], place[j]
    while len(i):
        x, y = root[i], root[j]
        apart = x != y
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    if len(moved):
        yield pa.RecordBatch.from_arrays([pa.array(names[moved], pa.int64()), pa.array(names[root[moved]], pa.int64())], ["a", "b"])


def _as_links(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _apart(rows: DataFrame) -> DataFrame:
    """Those of the rows ``node, component, key`` whose bucket holds more than one component."""
    ends = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return written(rows.join(ends.filter("low != high").select("key"), "key"), "near-apart")


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs ``a, b``: in every bucket the classes of other components against one class of the smallest component."""
    ends = rows.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("node", "component").alias("centre")
    )
    met = rows.join(ends.filter("low != high").select("key", "low", "centre"), "key").filter("component != low")
    return met.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()


def _tiles(rows: DataFrame, full: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, by tile; ``rows`` has key and node.

    A bucket is cut into parts of about ``MANY`` classes; each two parts, and each part by itself, are a tile.
    """
    placed = rows.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    placed = written(placed, "near-placed")
    ends = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("classes"))
    apart = ends.filter("low != high").select("key", F.ceil(F.col("classes") / MANY).alias("parts"))
    members = placed.join(apart, "key").join(full.select("node", "n", "sketch", "bands"), "node")
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    same = (F.col("part") == F.col("other")).alias("same")
    return members.select(tile.alias("tile"), "key", "part", same, "node", "component", "n", "sketch", "bands")


def _in_tiles(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], layout: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_by_tile(work), layout)


def _links_apart(rows: DataFrame, full: DataFrame, found: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``a, b`` between components that share a bucket: all pairs of its classes are compared, none is listed."""
    members = written(_in_tiles(_tiles(rows, full, found), _may_link, _MEMBER), "near-members")
    return _in_tiles(members.join(sets_of(members.select("node")), "node"), _joined, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per ``doc_id, text`` row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked where 100 * intersection >= 75 * union of their sets of five-word shingles; component_id is the
    smallest doc_id reachable over links, kept is doc_id = component_id. Null texts and texts without words have no
    shingles and stand alone. Rows of one doc_id are one document: they share their links. Rows without a doc_id count as
    one document behind all others and get a null component_id unless they are linked to a smaller one. An empty table
    gives no rows.
    """
    signed = written(_signed(docs), "near-signed")
    some = signed.filter("n > 0")
    classes = some.groupBy("h1", "h2").agg(F.min("doc").alias("node"), F.first("n").alias("n"))
    classes = written(classes, "near-classes")
    member = F.col("doc") == F.col("node")
    # the class's own row that its sketch and bands come from; equal sets have equal ones
    full = some.join(classes.select("h1", "h2", "node"), ["h1", "h2"]).filter(member).dropDuplicates(["h1", "h2"])
    full = written(full.select("node", "n", "sketch", "bands"), "near-full")
    checker = _Checker(docs, full)

    # rows of one id with different sets tie their classes together
    ids = some.join(classes.select("h1", "h2", "node"), ["h1", "h2"]).groupBy("doc")
    tied = ids.agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b").select("a", "b")
    links = written(tied, "near-tied")

    some_bands = full.select("node", F.explode(F.slice("bands", 1, STAR_BANDS)).alias("key"))
    found = components(links.unionAll(checker.confirmed(_stars(some_bands.withColumn("component", F.col("node"))))))

    # all bands; from here on only buckets that hold more than one component
    placed = full.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "bands")
    rows = _apart(placed.select("node", "component", F.explode("bands").alias("key")))
    links = written(_links_apart(rows.select("key", "node"), full, found, checker.sets_of), "near-links")
    found = components(_as_links(found).unionAll(links))
    placed = classes.select("h1", "h2", "node").join(found, "node", "left")
    placed = placed.select("h1", "h2", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc", "n", "h1", "h2").join(placed, ["h1", "h2"], "left")
    component = F.coalesce("component", "doc")
    hide = lambda c: F.when(c != LAST_ID, c)
    return out.select(
        hide(F.col("doc")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        hide(component).alias("component_id"),
        (F.col("doc") == component).alias("kept"),
    )
