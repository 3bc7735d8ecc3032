"""Language identification by hierarchical discrimination.

A text's byte n-grams go to a linear classifier of language families; inside the family, linear support vector machines
for each pair of its languages vote. Models are learnt from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import held_out
from tickloom.llm.linear import slope, svm

# Families of language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

BUCKETS = 8192
SAMPLE, PER_LANGUAGE = 4000, 400  # rows learnt from at most, in all and of one language
PART = 1 << 20
_LETTERS = np.full(256, 32, np.uint8)
for _c in (*range(65, 91), *range(97, 123), *range(128, 256)):
    _LETTERS[_c] = _c
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def family(code: str) -> str:
    return FAMILY_OF.get(code.lower().replace("_", "-").split("-")[0], code)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Weights of hashed byte n-grams of one to three letters of the whole text: length one, with a constant behind.

    Capitals and everything that is not a letter are levelled. Long texts are read in parts of a million characters.
    """
    counts = np.zeros(BUCKETS)
    for at in range(0, len(text), PART):
        b = _LETTERS[np.frombuffer(f" {text[at : at + PART].lower()} ".encode(), np.uint8)]
        b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))].astype(np.uint32)
        code = b
        for n, multiplier in enumerate(_MULTIPLIERS):
            if n:
                code = (code[:-1] << np.uint32(8)) | b[n:]
            counts += np.bincount(((code * multiplier) >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
    counts = np.sqrt(counts)
    return np.append(counts / max(np.linalg.norm(counts), 1e-9), 0.3)


class Model:
    """Family classifiers and pairwise classifiers, each with the slope that makes its margin log odds."""

    def __init__(self, x: np.ndarray, languages: list[str]) -> None:
        self.languages = sorted(set(languages))
        names = np.array(languages)
        families = np.array([family(c) for c in languages]) if languages else names
        self.families = sorted(set(families.tolist()))
        self.members = [[c for c in self.languages if family(c) == f] for f in self.families]
        self.of_family = [self._fit(x, np.where(families == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for members in self.members:
            for a, b in combinations(members, 2):
                rows = (names == a) | (names == b)
                self.pairs[a, b] = self._fit(x[rows], np.where(names[rows] == a, 1.0, -1.0))

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        kept = np.arange(len(x)) % 5 != 4 if min((y > 0).sum(), (y < 0).sum()) >= 10 else np.ones(len(x), bool)
        w = svm(x[kept], y[kept])
        checked = ~kept if not kept.all() else kept
        return (w * slope(x[checked] @ w, y[checked])).astype(np.float32)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language and the probability of its family times that of the language in it."""
        sure = 1.0
        at = 0
        if self.of_family:
            odds = np.array([w @ x for w in self.of_family])
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            at = int(odds.argmax())
            sure = float(p[at] / p.sum())
        members = self.members[at]
        votes = dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            p = float(1 / (1 + np.exp(-np.clip(self.pairs[a, b] @ x, -30, 30))))
            votes[a] += p
            votes[b] += 1 - p
        best = min(members, key=lambda c: (-votes[c], c))
        if len(members) > 1:
            sure *= 2 * votes[best] / (len(members) * (len(members) - 1)) if len(members) == 2 else votes[best] / (len(members) - 1)
        return best, min(max(sure, 0.0), 1.0)


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """A model from ``text, lang`` rows: a hash sample of distinct whole texts, bounded by the two parameters."""
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND lang != 'und'")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample // 8).collect()}
    each = max(8, min(per_language, sample // max(len(counts), 1)))
    if not counts:
        return Model(np.zeros((0, BUCKETS + 1)), [])
    share = F.create_map(*(F.lit(v) for c, n in counts.items() for v in (c, min(1.0, 3 * each / n))))
    draw = F.pmod(F.xxhash64("text"), F.lit(2**30))
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < F.try_element_at(share, F.col("lang")) * 2**30)
    drawn = drawn.groupBy("lang", "draw").agg(F.first("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("draw")
    drawn = drawn.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= each)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [grams(t.as_py()).astype(np.float32) for t in batch.column(2)]
            at = [np.flatnonzero(v).astype(np.int32) for v in x]
            columns = [pa.array(at, pa.list_(pa.int32())), pa.array([v[i] for v, i in zip(x, at, strict=True)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["lang", "draw", "at", "value"])

    got = drawn.select("lang", "draw", "text").mapInArrow(weigh, "lang string, draw long, at array<int>, value array<float>")
    taken = sorted(got.toArrow().to_pylist(), key=lambda r: (r["draw"], r["lang"]))
    x = np.zeros((len(taken), BUCKETS + 1), np.float32)
    for k, r in enumerate(taken):
        x[k, r["at"]] = r["value"]
    return Model(x, [r["lang"] for r in taken])


PREDICTED = "_language"


def with_language(docs: DataFrame, learnt_from: DataFrame | None = None) -> DataFrame:
    """``docs`` with the column ``_language``: the predicted code, ``und`` for texts without a letter.

    The model is learnt from ``learnt_from`` (``text, lang``), by default from all rows of ``docs``. Other columns and
    repeated rows stay as they are.
    """
    model = learn((docs if learnt_from is None else learnt_from).select("text", "lang"))
    return docs.withColumn(PREDICTED, _answer(model)(F.col("text"))["lang_pred"])


def _answer(model: Model):
    """A vectorised function from text to struct<lang_pred, score>."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def answer(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            codes, scores = [], []
            for text in column:
                code, score = _of(model, text.as_py() or "")
                codes.append(code)
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return answer


def _of(model: Model, text: str) -> tuple[str, float]:
    if not has_letter(text):
        return "und", 1.0
    return model.predict(grams(text)) if model.languages else ("und", 0.0)


def identify(docs: DataFrame, divisor: int = 4, at: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    Learns from texts and non-null languages of rows that are not held out (crc32 of doc_id modulo ``divisor`` is
    ``at``); a prediction sees the text alone. Null texts and texts without a letter are ``und`` with score 1, and so is
    everything, with score 0, where nothing can be learnt. Repeated rows get equal answers; ties go to the smaller code.
    """
    out = held_out(F.col("doc_id"), divisor, at)
    model = learn(docs.filter(~out).select("text", "lang"))

    rows = docs.select("doc_id", out.alias("held_out"), _answer(model)(F.col("text")).alias("answer"))
    return rows.select("doc_id", "held_out", "answer.lang_pred", "answer.score")
