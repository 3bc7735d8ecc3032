"""Line dedup by range-partitioned hashes. DataFrame functions only.

Lines become narrow rows (two 64-bit hashes of the key, document, position). Each task first keeps one row per key and
salt, so a line in every document does not follow its key to one task. What is left is range-partitioned by hash with
document and position as secondary order; the first row of a key in that order is its first occurrence. Texts are not
moved for this: the result is one run-length bitmap per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import LAST_ID, SPACES, ascii_lower
from tickloom.session import written

SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key() -> list[Column]:
    """Rows of one id and one text share a bitmap; rows of one id with different texts do not."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("text_hash")]


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``doc, text_hash, drop_runs`` of documents that lose lines; all lines of other documents stay.

    ``drop_runs`` is the compressed bitmap: an array of (start, length) runs of line positions that go. A line's key is
    the line stripped of white space, A-Z lower-cased; keys shorter than ``min_chars`` code points and keys of one
    document lose nothing, others stay in the smallest doc_id that holds them. A null doc_id is one document behind all
    others (``doc`` is the largest long). Null and empty texts have one empty line, which is too short to go.
    """
    position, line = F.posexplode(_lines(F.col("text"))).alias("pos", "line"), F.col("line")
    exploded = docs.select(*_row_key(), position)
    key = ascii_lower(F.btrim(line, F.lit(SPACES)))
    exploded = exploded.select("doc", "text_hash", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
    hashes = [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")]
    keyed = written(exploded.select(*hashes, "doc", "text_hash", "pos"), "line-keys")

    partial = keyed.groupBy("h1", "h2", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt")).agg(
        F.min(F.col("doc")).alias("first_doc"), F.max("doc").alias("last_doc")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = partial.repartitionByRange(parts, "h1", "h2")
    streamed = Window.partitionBy("h1", "h2").orderBy("first_doc", "last_doc")
    firsts = ranged.select(
        "h1",
        "h2",
        "first_doc",
        F.row_number().over(streamed).alias("nth"),
        F.max("last_doc").over(Window.partitionBy("h1", "h2")).alias("last_doc"),
    ).filter("nth = 1 AND last_doc > first_doc")
    owners = written(firsts.select("h1", "h2", "first_doc"), "line-owners")

    later = keyed.join(owners, ["h1", "h2"]).filter(F.col("doc") != F.col("first_doc"))
    dropped = later.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))
    return dropped.select("doc", "text_hash", runs.alias("drop_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the struct ``_lines`` added: n_lines, n_dropped and the kept text."""
    keyed = docs.select("*", F.struct(*_row_key()).alias("_row"))
    marks = bitmaps.select(F.struct("doc", "text_hash").alias("_marked"), "drop_runs")
    same = (F.col("_row.doc") == F.col("_marked.doc")) & (F.col("_row.text_hash") == F.col("_marked.text_hash"))
    joined = keyed.join(marks.withColumnRenamed("drop_runs", "_runs"), same, "left")
    # each input of the lambdas is a column of its own, else every call would split the text again
    steps = F.transform("_runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1))
    joined = joined.withColumn("_gone", F.coalesce(F.flatten(steps), F.array().cast("array<int>")))
    joined = joined.withColumn("_split", _lines(F.col("text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("_gone"))
    joined = joined.withColumn("_left", left)
    kept = F.array_join(F.transform("_left", lambda i: F.get("_split", i)), "\n")
    n_lines, n_left = F.size("_split").cast("long"), F.size("_left").cast("long")
    full = F.when(F.size("_gone") == 0, F.coalesce(F.col("text"), F.lit(""))).otherwise(kept)
    out = F.struct(n_lines.alias("n_lines"), (n_lines - n_left).alias("n_dropped"), full.alias("text"))
    return joined.select(*docs.columns, out.alias("_lines"))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with its own columns and the text of the lines that stay; a null text stays null.

    Repeated rows of a document keep their lines together; no row goes, a text may become empty.
    """
    applied = apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
    text = F.when(F.col("text").isNotNull(), F.col("_lines.text")).alias("text")
    return applied.select(*[text if c == "text" else F.col(c) for c in docs.columns])


def line_report(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    narrow = docs.select("doc_id", "text")
    applied = apply_bitmaps(narrow, keep_bitmaps(narrow, min_chars))
    return applied.select(
        "doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.col("_lines.text").cast("binary"), 256).alias("kept_sha256")
    )
