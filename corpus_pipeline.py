"""A training-data pipeline over the documents table: five stages, each reading what the one before it wrote.

Every stage takes ``(spark, docs, sf_dir)`` and returns rows of documents; the last returns packed sequences. Columns that
a stage has no use for pass through it in one struct, so their names cannot meet names that an operator uses itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import languages, lines, mixing, neardup, packing
from tickloom.llm.common import WORD
from tickloom.session import configure, written

# Language models and mixtures over hashes have no SQL form.
ORACLE_SQL = None

_USED = ("doc_id", "text", "lang", "source", "n_chars")


def _beside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` on the columns of documents; all others go with their rows."""
    others = [c for c in docs.columns if c not in _USED]
    if not others:
        return operator(docs).select(docs.columns)
    own = [c for c in docs.columns if c in _USED]
    held = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in others]).alias("other_columns"))
    out = operator(held)
    return out.select([F.col(c) if c in own else F.col("other_columns").getField(c).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; where ``lang`` is null, it becomes the language that the text is identified as.

    A text goes for its own content only: null and empty texts and texts without a letter have no language. Languages are
    learnt from the rows that name one; where no row does, all texts with a letter stay as they are. Repeated rows and
    ties get equal answers, very long texts are read whole, an empty table gives no rows.
    """
    del sf_dir
    configure(spark)

    def identified(rows: DataFrame) -> DataFrame:
        told = languages.with_language(rows)
        known = F.when(F.col(languages.PREDICTED) != "und", F.col(languages.PREDICTED))
        letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        kept = told.filter(known.isNotNull() | letter)
        return kept.withColumn("lang", F.coalesce("lang", known)) if "lang" in rows.columns else kept

    return _beside(docs, identified)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has; n_chars follows the text where there is one.

    No row goes: a document whose lines are all held by earlier ones stays with an empty text, and ``mixing`` takes no
    document without words. Null texts stay null. Of equal lines the smallest doc_id keeps its own; a null doc_id is one
    document behind all others. Repeated rows keep their lines together; very long texts are split whole; an empty table
    gives no rows.
    """
    del sf_dir
    configure(spark)

    def deduped(rows: DataFrame) -> DataFrame:
        out = lines.dedup_lines(rows)
        return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out

    return _beside(docs, deduped)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, all its rows.

    Texts that are null or without words are near nothing and stay. Rows of one doc_id, and all rows without one, are one
    document each; repeated rows stay or go together. An empty table gives no rows.
    """
    del sf_dir
    configure(spark)
    kept = neardup.near_duplicates(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return _beside(docs, lambda rows: rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; documents without words, null texts included, are not taken.

    A null source is a source of its own. Repeated rows, and rows without a doc_id, share one decision; reruns agree. An
    empty table, or one without words, gives no rows.
    """
    del sf_dir
    configure(spark)
    worded = docs.filter(F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return _beside(worded, mixing.mixed)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences, as ``packing.pack`` returns them.

    Null and empty texts are one end token. Repeated rows are packed each; very long texts are cut into whole sequences
    and a rest. An empty table gives no rows.
    """
    del sf_dir
    configure(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_sources),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
