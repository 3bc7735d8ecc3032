"""Best-fit packing by exact-complement hashing.

How full sequences can get depends on the counts of lengths alone, and there are at most ``size`` lengths. The driver
plans over that histogram: sequences are patterns of lengths with a multiplicity. Sums of one, two and three lengths are
indexed; from the longest length down, combinations that fill its gap exactly are consumed under the availability counts,
and what is left is packed best-fit, also by counts. Pieces then take the slots of their length by rank, in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import small
from tickloom.llm.vocabulary import is_wordwise, library, path, word_ids
from tickloom.session import written

SIZE = 2048
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, salt long"


class Complements:
    """Combinations of up to three available lengths by their sum.

    Availability only falls, so each sum keeps a pointer to its next candidate that never turns back: all searches
    together cost one pass over the index.
    """

    def __init__(self, available: list[int]) -> None:
        self.n = available
        self.pair_at = list(range(len(available)))
        self.triple_at = list(range(len(available)))

    def _has(self, *lengths: int) -> bool:
        return all(self.n[x] >= lengths.count(x) for x in lengths)

    def pair(self, total: int, *used: int) -> tuple[int, ...] | None:
        """Two lengths of that sum that are there beside those ``used``; only what is gone for good moves the pointer."""
        a, gone = min(self.pair_at[total], total - 1), True
        while 2 * a >= total:
            if self._has(a, total - a):
                if gone:
                    self.pair_at[total], gone = a, False
                if self._has(*used, a, total - a):
                    return a, total - a
            a -= 1
        if gone:
            self.pair_at[total] = a
        return None

    def triple(self, total: int, *used: int) -> tuple[int, ...] | None:
        a, gone = min(self.triple_at[total], total - 2), True
        while 3 * a >= total:
            if self.n[a] and self.pair(total - a, a):
                if gone:
                    self.triple_at[total], gone = a, False
                if self._has(*used, a) and (two := self.pair(total - a, *used, a)):
                    return a, *two
            a -= 1
        if gone:
            self.triple_at[total] = a
        return None

    def filling(self, length: int, gap: int) -> tuple[int, ...] | None:
        """The fewest lengths that fill ``gap`` beside one of ``length``."""
        if gap <= 0:
            return ()
        if self._has(length, gap):
            return (gap,)
        return self.pair(gap, length) or self.triple(gap, length)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``([(length, how often), ...], sequences)`` that use up ``histogram``, none longer than ``size``."""
    n = [0] * (size + 1)
    for length, count in histogram.items():
        n[length] = count
    index, out = Complements(n), []
    for length in range(size, 0, -1):
        while n[length] and (fill := index.filling(length, size - length)) is not None:
            parts = (length, *fill)
            times = min(n[x] // parts.count(x) for x in parts)
            for x in parts:
                n[x] -= times
            out.append(([(x, parts.count(x)) for x in sorted(set(parts), reverse=True)], times))
    return out + _best_fit(n, size)


def _best_fit(n: list[int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing by counts: open patterns by free room; equal sequences are filled together."""
    room: list[list[tuple[list[tuple[int, int]], int]]] = [[] for _ in range(size + 1)]
    for length in range(size, 0, -1):
        left, at = n[length], length
        while left:
            while at <= size and not room[at]:
                at += 1
            if at > size:
                each = min(size // length, left)
                bins = left // each
                room[size - each * length].append(([(length, each)], bins))
                left -= each * bins
                at = length
                continue
            parts, bins = room[at].pop()
            each = min(at // length, left)
            filled = min(bins, left // each)
            if bins > filled:
                room[at].append((parts, bins - filled))
            room[at - each * length].append(([*parts, (length, each)], filled))
            left -= each * filled
            at = length
    return [p for same in room for p in same]


class Slots:
    """Where the piece of a length and rank goes: arrays over (length, first rank), one entry per pattern and length."""

    def __init__(self, patterns: Iterable[tuple[list[tuple[int, int]], int]], size: int = SIZE) -> None:
        rows, taken, first = [], [0] * (size + 1), 0
        for parts, times in patterns:
            offset = 0
            for length, each in parts:
                rows.append((length, taken[length], each, first, offset))
                taken[length] += each * times
                offset += length * each
            first += times
        rows.sort()
        self.sequences = first
        table = np.array(rows, np.int64).reshape(-1, 5).T
        self.length, self.rank, self.each, self.first, self.offset = table
        starts = np.searchsorted(self.length, np.arange(size + 2))
        self.bounds = starts

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.empty(len(length), np.int64)
        for x in np.unique(length):
            lo, hi = self.bounds[x], self.bounds[x + 1]
            mine = length == x
            row[mine] = lo + np.searchsorted(self.rank[lo:hi], rank[mine], "right") - 1
        within = rank - self.rank[row]
        each = self.each[row]
        return self.first[row] + within // each, self.offset[row] + within % each * length


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """One row per piece of a document: its ids and one id 0, cut at ``size``; with a salt that spreads equal lengths."""
    file = path(vocabulary)
    wordwise = is_wordwise(file)

    def encoded(texts: list[str]) -> list[bytes]:
        if wordwise:
            return [b"".join(ids) for ids in word_ids(file).ids(texts)]
        return [np.array(library(file).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = count()
        for batch in small(batches):
            out: list[tuple] = []
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for k, ids in zip(keys, encoded(texts), strict=True):
                ids += b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part), next(rows)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
            kinds = [batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 4]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(id=kind))


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", size: int = SIZE) -> DataFrame:
    """Places the pieces of ``doc_id, text`` rows: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and an end id 0; a null or empty text is the end id alone. Only documents longer than ``size``
    are cut. Repeated rows are packed each. Pieces of one length are interchangeable, so ties change which of them sits
    where, never how full sequences are. An empty table gives no rows.
    """
    cut = written(pieces(docs, vocabulary, size), "pack-pieces")
    lengths = cut.groupBy("length").count()
    slots = Slots(plan({r["length"]: r["count"] for r in lengths.collect()}, size), size)

    salts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod("salt", F.lit(salts)))
    sums = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    group = Window.partitionBy("length", "salt")
    ranked = salted.withColumn("nth", F.row_number().over(group.orderBy("doc_id", "piece")))
    ranked = ranked.join(written(sums, "pack-bases"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = slots.place(length, rank)
            columns = [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, layout)
