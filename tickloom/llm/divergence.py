"""Source divergence audit: how the sources of a language differ from each other and from the language, term by term.

Terms that enough documents of a language hold are its vocabulary. The sorted vocabulary is cut into slices of bounded
size, each a minimal acyclic transducer from term to lexicographic ordinal. The text is read again and streamed through
the transducers: terms are folded per task, sent to the slice their range belongs to and counted by ordinal, so
everything behind works on numbers; ties go by ordinal, and only the terms of the report are turned back into text. All
arithmetic is on integers.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import small
from tickloom.llm.transducer import Transducer, build
from tickloom.session import written

LEAST = 10  # documents of a language that hold a kept term
TOP = 10  # ranks of terms that are reported
SLICE = 65_536  # terms of a transducer, at most four times that
HELD = 400_000  # folded terms that a task holds
SALTS = 8  # parts that the terms of a slice are dealt to
SIDE = 128  # sources of a tile's side
STRIP = 13  # bits of the ordinals that one task sums a tile over
SCALE = 1_000_000_000

# All bytes but A-Z, a-z and those of characters outside ASCII become spaces; A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_Batches = Iterable[pa.RecordBatch]
_Rows = Iterator[pa.RecordBatch]


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _key(lang: str) -> bytes:
    """What terms of a language are sorted behind; no term holds the byte that ends it."""
    return lang.encode() + b"\0"


def _folded(docs: DataFrame) -> DataFrame:
    """Rows ``key, documents``: per task, in how many documents a language's term occurs."""

    def fold(batches: _Batches) -> _Rows:
        held: dict[bytes, Counter] = {}

        def out() -> pa.RecordBatch:
            keys = [lang + t for lang, found in held.items() for t in found]
            columns = [pa.array(keys, pa.binary()), pa.array([n for c in held.values() for n in c.values()], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "documents"])

        for batch in small(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(_key(lang), Counter()).update(set(terms(text)))
            if sum(map(len, held.values())) > HELD:
                yield out()
        if held:
            yield out()

    return docs.select("lang", "text").mapInArrow(fold, "key binary, documents long")


def transducers(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``slice, first, machine, langs, sizes``: the kept terms of ``lang, text`` rows in slices of their order.

    ``langs`` and ``sizes`` say how many terms of each language a slice has.
    """
    kept = _folded(docs).groupBy("key").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= least).select("key")
    kept = written(kept, "kept-terms")

    def make(batches: _Batches) -> _Rows:
        number = TaskContext.get().partitionId() << 8

        def out(words: list[bytes]) -> pa.RecordBatch:
            sizes = Counter(w.rpartition(b"\0")[0].decode() for w in words)
            row = [number, words[0], build(words), list(sizes), list(sizes.values())]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["slice", "first", "machine", "langs", "sizes"])

        words: list[bytes] = []
        for batch in batches:
            words += batch.column(0).to_pylist()
            if len(words) >= 4 * SLICE:
                yield out(words)
                number, words = number + 1, []
        if words:
            yield out(words)

    parts = max(1, -(-kept.count() // SLICE))
    ranged = kept.repartitionByRange(parts, "key").sortWithinPartitions("key")
    return written(ranged.mapInArrow(make, "slice long, first binary, machine binary, langs array<string>, sizes array<long>"), "transducers")


def _through(machines: DataFrame, rows: DataFrame, work: Callable[[_Batches], _Rows], layout: str) -> DataFrame:
    """Rows with a ``slice`` and a ``salt`` behind the transducer of their slice, in one stream per task."""
    salted = machines.select("slice", "machine").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = salted.unionByName(rows, allowMissingColumns=True)
    return both.repartition("slice", "salt").sortWithinPartitions("slice", "salt", F.col("machine").isNull()).mapInArrow(work, layout)


def _runs(batches: _Batches) -> Iterator[tuple[Transducer, pa.RecordBatch]]:
    """The rows of a stream of ``_through``, with the transducer in front of them."""
    machine: Transducer | None = None
    for batch in batches:
        raw = batch.column("machine")
        heads = np.flatnonzero(raw.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for at, to in zip([-1, *heads], [*heads, batch.num_rows], strict=True):
            if at >= 0:
                machine = Transducer(raw[at].as_py())
            if at + 1 < to:
                yield machine, batch.slice(at + 1, to - at - 1)


def recounted(docs: DataFrame, machines: DataFrame) -> DataFrame:
    """``lang, source, ordinal, n``: occurrences of kept terms; ordinals are slice and rank in it, in one number.

    A task folds its text; what it has found of a group and a slice travels as one row, terms and counts packed.
    """
    # one row per SLICE terms
    bounds = sorted((bytes(r["first"]), r["slice"]) for r in machines.select("first", "slice").collect())
    firsts, slices = [b[0] for b in bounds], [b[1] for b in bounds]
    layout = "slice long, salt int, lang string, source string, terms binary, counts binary"

    def fold(batches: _Batches) -> _Rows:
        held: dict[tuple[str, str], Counter] = {}
        salt = TaskContext.get().partitionId() % SALTS
        names = [f.split()[0] for f in layout.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary()]

        def out() -> _Rows:
            rows = []
            for (lang, source), found in held.items():
                # slices that begin inside the language cut its terms; the one before may hold its first ones
                key = _key(lang)
                lo, hi = bisect_right(firsts, key), bisect_right(firsts, key[:-1] + b"\1")
                inside = [f[len(key) :] for f in firsts[lo:hi] if f.startswith(key)]
                parts: list[list[bytes]] = [[] for _ in range(len(inside) + 1)]
                if inside:
                    for t in found:
                        parts[bisect_right(inside, t)].append(t)
                else:
                    parts[0] = list(found)
                for at, some in enumerate(parts, lo - 1):
                    if some and at >= 0:  # terms before the first slice are not kept
                        counts = np.fromiter(map(found.__getitem__, some), np.int64, len(some))
                        rows.append((slices[at], salt, lang, source, b" ".join(some), counts.tobytes()))
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in small(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((lang, source), Counter()).update(terms(text))
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    def count(batches: _Batches) -> _Rows:
        held: dict[tuple[int, str, str], list] = {}

        def out() -> _Rows:
            for (number, lang, source), found in held.items():
                ranks, at = np.unique(np.concatenate([r for r, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in found]), len(ranks)).astype(np.int64)
                group = [pa.array([v] * len(ranks), pa.string()) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*group, pa.array(number << 32 | ranks, pa.int64()), pa.array(n, pa.int64())], ["lang", "source", "ordinal", "n"])
            held.clear()

        for machine, rows in _runs(batches):
            columns = (rows.column(c).to_pylist() for c in ("slice", "lang", "source", "terms", "counts"))
            for number, lang, source, found, counts in zip(*columns, strict=True):
                ranks = machine.ranks(found.split(), _key(lang))
                kept = ranks >= 0
                held.setdefault((number, lang, source), []).append((ranks[kept], np.frombuffer(counts, "<i8")[kept]))
            if sum(len(r) for found in held.values() for r, _ in found) > HELD:
                yield from out()
        yield from out()

    folded = docs.select("lang", "source", "text").mapInArrow(fold, layout)
    counted = _through(machines, folded, count, "lang string, source string, ordinal long, n long")
    return counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def vocabulary_sizes(machines: DataFrame) -> DataFrame:
    """``lang, v``: kept terms of each language that has some."""
    sizes = machines.select(F.explode(F.arrays_zip("langs", "sizes")).alias("of")).select("of.langs", "of.sizes")
    return sizes.groupBy(F.col("langs").alias("lang")).agg(F.sum("sizes").alias("v"))


def shares(counts: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * v))`` by long division, three digits at a time: nothing overflows."""
    below = np.broadcast_to(total + 2 * v, counts.shape)
    out, rest = np.divmod(counts + 2, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + more
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def share(count: str, total: str, v: str) -> Column:
    """``shares`` as a column; the product is a decimal."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast({total} + 2 * {v} as decimal(20,0))")


def _pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: for two sources of a language, each way, the sum over all kept terms.

    Sources are cut into parts; two parts are a tile. A task takes a tile over a strip of ordinals: it knows the tile's
    totals from the strip's first row, lays terms that one of its sources has on a dense matrix, and sums what they
    differ from terms that neither has. Those are added once, for all kept terms.
    """
    order = Window.partitionBy("lang").orderBy("source")
    numbered = groups.withColumn("place", F.row_number().over(order) - 1).withColumn("part", F.floor(F.col("place") / SIDE))
    member = F.struct("place", "source", "total").alias("member")
    parts = numbered.groupBy("lang", "part", "v").agg(F.collect_list(member).alias("members"))
    left, right = parts.select("lang", "v", F.col("part").alias("low"), F.col("members").alias("a")), parts.select("lang", F.col("part").alias("high"), F.col("members").alias("b"))
    tiles = left.join(right, "lang").filter("low <= high")
    placed = counts.join(numbered.select("lang", "source", "place", "part"), ["lang", "source"]).withColumn("strip", F.shiftright("ordinal", STRIP))
    strips = placed.select("lang", "strip").distinct().unionAll(groups.select("lang", F.lit(-1).cast("long")).distinct())
    heads = tiles.join(strips, "lang").select("lang", "low", "high", "strip", "v", "a", "b")
    ends = parts.groupBy("lang").agg(F.max("part").alias("last"))
    met = placed.join(ends, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    keys = ["lang", "low", "high", "strip"]
    met = met.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    cells = met.groupBy(*keys, "ordinal").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("ns"))
    both = heads.unionByName(cells, allowMissingColumns=True)
    both = both.repartition(*keys).sortWithinPartitions(*keys, F.col("a").isNull())

    def out(head: tuple, sums: np.ndarray) -> pa.RecordBatch:
        lang, own, a, b, _ = head
        i, j = np.nonzero(np.triu(np.ones(sums.shape, bool), 1) if own else np.ones(sums.shape, bool))
        columns = [[lang] * len(i), [a[k]["source"] for k in i.tolist()], [b[k]["source"] for k in j.tolist()]]
        arrays = [*(pa.array(c, pa.string()) for c in columns), pa.array(sums[i, j], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "item", "value"])

    def add(sums: np.ndarray, head: tuple, rows: list[tuple]) -> None:
        _, own, a, b, v = head
        if not v or not rows:
            return
        at = {m["place"]: k for k, m in enumerate(a)} | ({} if own else {m["place"]: len(a) + k for k, m in enumerate(b)})
        total = np.array([m["total"] for m in (a if own else a + b)], np.int64)
        dense = np.zeros((len(rows), len(total)), np.int64)
        for k, (places, ns) in enumerate(rows):
            dense[k, [at[p] for p in places]] = ns
        p, none = shares(dense, total, v), shares(np.zeros(len(total), np.int64), total, v)
        right = slice(None) if own else slice(len(a), None)
        for i in range(len(a)):
            sums[i] += apart(p[:, i, None], p[:, right]).sum(axis=0) - len(rows) * apart(none[i], none[right])

    def work(batches: _Batches) -> _Rows:
        head, sums, rows = None, np.zeros((0, 0), np.int64), []
        for batch in batches:
            for r in batch.to_pylist():
                if r["a"] is None:
                    rows.append((r["places"], r["ns"]))
                    if len(rows) == 2048:
                        add(sums, head, rows)
                        rows = []
                    continue
                if head is not None:
                    add(sums, head, rows)
                    yield out(head, sums)
                a, b = (sorted(r[k], key=lambda m: m["place"]) for k in "ab")
                head, rows = (r["lang"], r["low"] == r["high"], a, b, r["v"]), []
                sums = np.zeros((len(a), len(b)), np.int64)
                if r["strip"] < 0 and r["v"]:  # terms that neither source has, as if they were all
                    none = [shares(np.zeros(len(m), np.int64), np.array([x["total"] for x in m], np.int64), r["v"]) for m in (a, b)]
                    sums += r["v"] * apart(none[0][:, None], none[1][None])
        if head is not None:
            add(sums, head, rows)
            yield out(head, sums)

    sums = both.mapInArrow(work, "lang string, source string, item string, value long")
    one = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return one.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")


def _top_terms(counts: DataFrame, groups: DataFrame, machines: DataFrame, top: int) -> DataFrame:
    """``lang, source, item, value, rank``: the terms of a group that are most above their language's share."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    of_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("m"))
    rows = counts.join(of_lang, ["lang", "ordinal"]).join(groups, ["lang", "source"]).join(whole, "lang")
    rows = rows.select("lang", "source", "ordinal", share("n", "total", "v").alias("p"), share("m", "all", "v").alias("q")).filter("p > q")
    rows = rows.select("lang", "source", "ordinal", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    best = best.withColumn("slice", F.shiftright("ordinal", 32)).withColumn("salt", F.pmod(F.hash("lang", "source"), F.lit(SALTS)))

    def name(batches: _Batches) -> _Rows:
        for machine, rows in _runs(batches):
            ranks = (rows.column("ordinal").to_numpy() & 0xFFFFFFFF).tolist()
            item = pa.array([machine.word(r).rpartition(b"\0")[2].decode() for r in ranks], pa.string())
            columns = [rows.column("lang"), rows.column("source"), item, rows.column("value"), rows.column("rank")]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value", "rank"])

    return _through(machines, best, name, "lang string, source string, item string, value long, rank int")


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``text, lang, source`` rows, of which null counts as empty.

    Terms are runs of letters A-Z (lower-cased), a-z and characters outside ASCII. A language keeps the V terms that at
    least ``least`` of its documents hold. A group (lang, source) and a language give each kept term
    ``p = 1 + floor(1e9 * (count + 2) / (N + 2 V))``, N being their occurrences of kept terms; two shares differ by
    ``floor((p - q)^2 / (p + q))``. Part ``pair`` has, for every group, all other sources of its language by the sum over
    all kept terms (0 where there are none). Part ``term`` has the group's ``top`` terms with a share above the
    language's. Ranks go by value, then by item in byte order. Every row counts as a document, so repeated rows count
    again; a language with one source has no pairs; an empty table gives no rows; other columns are not read.
    """
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    machines = transducers(texts, least)
    counts = written(recounted(texts, machines), "term-counts")
    groups = texts.select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(vocabulary_sizes(machines), "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "term-groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pair_sums(counts, groups).withColumn("rank", F.row_number().over(order))
    found = _top_terms(counts, groups, machines, top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionAll(found.withColumn("part", F.lit("term")).select(columns))
