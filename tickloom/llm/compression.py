"""Quality scores by compression: dictionaries of good and of bad text, and which of them makes a text smaller."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import held_out
from tickloom.llm.linear import logistic
from tickloom.session import written

SAMPLE = 4000  # labelled rows learnt from at most, half of them of each label
MATERIAL = 64 * 1024  # bytes of a sampled text that may go into the making of a dictionary
DICTIONARY, LEVEL, BLOCK = 112 * 1024, 3, 2048


def blocks(raw: bytes) -> list[bytes]:
    return [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]


def material_of(raw: bytes, most: int = MATERIAL) -> list[bytes]:
    """A text's blocks for the dictionaries: all of them, or of a text of over ``most`` bytes as many, evenly spread."""
    parts = blocks(raw)
    count = max(1, most // BLOCK)
    return parts if len(parts) <= count else [parts[i] for i in np.linspace(0, len(parts) - 1, count).astype(int).tolist()]


def dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary, or the blocks themselves, the last ones that fit, where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


class Sizes:
    """Bytes of a text's blocks under both dictionaries and without one."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.ways = [zstandard.ZstdCompressor(**options)]
        for raw in (good, bad):
            made = zstandard.ZstdCompressionDict(raw)
            made.precompute_compress(level=LEVEL)
            self.ways.append(zstandard.ZstdCompressor(dict_data=made, **options))

    def features(self, raw: bytes) -> list[float]:
        """The size difference over the sum of both sizes first, then what the calibration corrects it by: sizes per byte
        and their difference. All are zero for an empty text."""
        if not raw:
            return [0.0] * 4
        parts = blocks(raw)
        plain, good, bad = (sum(len(way.compress(p)) for p in parts) for way in self.ways)
        return [(bad - good) / (bad + good), (bad - good) / len(raw), min(good, bad) / len(raw), plain / len(raw)]


def _expand(x: np.ndarray) -> np.ndarray:
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.column_stack([x, *pairs, np.ones(len(x))])


class Model:
    """Both dictionaries and the calibration from sizes to the probability of label 1."""

    def __init__(self, odds: float, dictionaries: tuple[bytes, bytes] | None = None, measured: list[tuple[int, list[float]]] = ()) -> None:
        """``odds``: label 1 over label 0; ``dictionaries`` of good and of bad text; ``measured``: label and features of
        whole texts that no dictionary is made of. Without both, or with one label only, the score is the prior."""
        self.prior = odds / (1 + odds)
        self.weights = None
        if dictionaries is None or len({y for y, _ in measured}) < 2:
            return
        self.good, self.bad = dictionaries
        y = np.array([y for y, _ in measured], float)
        x = np.array([f for _, f in measured])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        each = np.where(y > 0, self.prior / max(y.mean(), 1e-9), (1 - self.prior) / max(1 - y.mean(), 1e-9))
        self.weights = logistic(_expand((x - self.mean) / self.scale), y, each, ridge=1.0)

    def scorer(self):
        if self.weights is None:
            return lambda raw: self.prior
        sizes = Sizes(self.good, self.bad)

        def score(raw: bytes) -> float:
            if not raw:
                return self.prior
            x = (np.array([sizes.features(raw)]) - self.mean) / self.scale
            return float(1 / (1 + np.exp(-np.clip(_expand(np.clip(x, -8, 8)) @ self.weights, -30, 30)[0])))

        return score


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, material: int = MATERIAL) -> Model:
    """A model from ``doc_id, text`` and ``doc_id, quality``: at most ``sample`` rows, drawn by hash of doc_id.

    Half of the sampled rows calibrate the score: their whole texts are compressed in the tasks, and only four numbers of
    each come to the driver. The other half makes the dictionaries, from at most ``material`` bytes of each text, evenly
    spread over it. Documents with contradicting labels are left out; of rows repeated under one id, the one with the
    smallest text hash is used.
    """
    one = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
    one = one.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    counts = {r["quality"]: r["count"] for r in one.groupBy("quality").count().collect()}
    odds = (counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)
    if not counts:
        return Model(1.0)
    half = sample // 2
    draw = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(2**30))
    drawn = None
    for label in (0, 1):
        share = min(1.0, 2 * half / max(counts.get(label, 0), 1))
        part = one.filter(F.col("quality") == label).withColumn("draw", draw).filter(F.col("draw") < share * 2**30)
        part = part.orderBy("draw", "doc_id").limit(half).select("doc_id", "quality", "draw")
        drawn = part if drawn is None else drawn.unionAll(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    text = F.coalesce("text", F.lit(""))
    texts = texts.groupBy("draw", F.col("quality").cast("int").alias("quality")).agg(F.min_by(text, F.xxhash64(text)).alias("text"))
    order = Window.partitionBy("quality").orderBy("draw")  # at most half of the sample
    texts = written(texts.withColumn("nth", F.row_number().over(order)), "quality-sample")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [material_of(t.as_py().encode(), material) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(parts, pa.list_(pa.binary()))], ["draw", "quality", "parts"])

    odd, even = (texts.filter(F.col("nth") % 2 == k).select("draw", "quality", "text") for k in (1, 0))
    made = sorted(odd.mapInArrow(cut, "draw long, quality int, parts array<binary>").toArrow().to_pylist(), key=lambda r: r["draw"])
    good, bad = ([b for r in made if r["quality"] == label for b in r["parts"]] for label in (1, 0))
    if not good or not bad:
        return Model(odds)
    dictionaries = dictionary(good), dictionary(bad)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*dictionaries)
        for batch in batches:
            found = [sizes.features(t.as_py().encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.float64()))], ["draw", "quality", "features"])

    measured = even.mapInArrow(measure, "draw long, quality int, features array<double>").toArrow().to_pylist()
    measured.sort(key=lambda r: (r["quality"], r["draw"]))
    return Model(odds, dictionaries, [(r["quality"], r["features"]) for r in measured])


def quality_scores(docs: DataFrame, labels: DataFrame, divisor: int = 3, at: int = 1) -> DataFrame:
    """One row per document row: ``doc_id, held_out, score, predicted``.

    Labels are learnt from rows that are not held out (crc32 of doc_id modulo ``divisor`` is ``at``); a score sees the
    whole text alone. Null and empty texts score the share of label 1, and so do all texts where one label is missing
    (one half without any labels). Equal texts have equal scores; a score of exactly 0.5 predicts 1.
    """
    known = labels.select("doc_id", "quality").filter(~held_out(F.col("doc_id"), divisor, at))
    model = learn(docs, known)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            scores = [of((t.as_py() or "").encode()) for t in batch.column(2)]
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id"), divisor, at).alias("held_out"), "text")
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
