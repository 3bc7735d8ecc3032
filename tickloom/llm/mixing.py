"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Every document has a hash of 36 bits. A source whose target is *k* whole copies and a rest takes each document *k* times
and once more where the hash is below a threshold. The threshold is found without sorting documents: words are summed by
(source, upper 12 bits), the bucket the rest ends in is cut by the next 12 bits, and that one by the last 12.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD
from tickloom.session import written

BITS, LEVELS = 12, 3


def targets(by_source: DataFrame, cap: int = 3, weights: int = 3) -> DataFrame:
    """Word targets of sources: one row per source in, ``source, source_size, target`` out.

    Weights are 1 to ``weights``, repeating, in order of the source's code points, null last. A target stops at ``cap``
    times the source's size and the excess is shared again by weight, until none is above: the level at which
    ``min(cap * size, level * weight)`` adds up to all words. Sources are ordered in one task; a row is a name and a sum.
    """
    ordered = Window.orderBy(F.asc_nulls_last("source"))
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = by_source.withColumn("rank", F.row_number().over(ordered)).withColumn(
        "weight", ((F.col("rank") - 1) % weights + 1).cast("long")
    )
    ranked = ranked.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # the first source by ratio that its level does not fill; from there on nobody is full
    level = F.when(F.col("ratio") >= F.col("at"), F.struct("ratio", "rank", "at"))
    fits = ranked.withColumn("at", left / heavy).withColumn("level", F.min(level).over(everything)["at"])
    return fits.select(
        "source",
        "source_size",
        F.when(F.col("ratio") < F.col("level"), F.col("most").cast("double"))
        .otherwise(F.col("level") * F.col("weight"))
        .alias("target"),
    )


def _boundary(sums: DataFrame) -> DataFrame:
    """The bucket of each source in which its rest ends: ``sums`` has source, rest, below, bucket, words."""
    up_to = Window.partitionBy("source").orderBy("bucket")
    through = F.col("below") + F.sum("words").over(up_to)
    marked = sums.withColumn("through", through).filter(F.col("through") > F.col("rest"))
    first = Window.partitionBy("source").orderBy("bucket")
    return marked.withColumn("n", F.row_number().over(first)).filter("n = 1").select(
        "source", "rest", (F.col("through") - F.col("words")).alias("below"), "through", "bucket"
    )


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _hash():
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 9), 16, 10).cast("long")


def mix_plan(docs: DataFrame, cap: int = 3) -> DataFrame:
    """One row per source: ``source, source_size, target``, whole copies, and the hash limit below which documents are
    taken once more (null: all are)."""
    sized = written(docs.select("source", _size().alias("size"), _hash().alias("hash")), "mix-sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("long"))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    found = plan.select("source", "rest", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    for depth in range(1, LEVELS + 1):
        inner = sized.select("source", "size", F.shiftright("hash", BITS * (LEVELS - depth)).alias("bucket"))
        same = inner["source"].eqNullSafe(found["source"])
        joined = inner.join(found, same & (F.shiftright(inner["bucket"], BITS) == found["prefix"]))
        sums = joined.groupBy(inner["source"], "rest", "below", "bucket").agg(F.sum("size").alias("words"))
        found = written(_boundary(sums).withColumnRenamed("bucket", "prefix"), "mix-edge")
    nearer = F.col("through") - F.col("rest") < F.col("rest") - F.col("below")
    edges = found.select(F.col("source").alias("edge_source"), (F.col("prefix") + nearer.cast("long")).alias("limit"))
    plan = plan.join(edges, plan["source"].eqNullSafe(edges["edge_source"]), "left")
    return written(plan.select("source", "source_size", "target", "whole", "limit"), "mix-plan")


def _with_plan(docs: DataFrame, cap: int) -> DataFrame:
    plan = mix_plan(docs, cap)
    plan = plan.select(F.col("source").alias("_mix_source"), F.struct(*plan.columns).alias("_mix"))
    joined = docs.join(plan, docs["source"].eqNullSafe(plan["_mix_source"])).drop("_mix_source")
    once_more = F.coalesce(_hash() < F.col("_mix.limit"), F.lit(True)) & (F.col("_mix.whole") < cap)
    copies = F.when(F.col("_mix.source_size") > 0, F.col("_mix.whole") + once_more.cast("long")).otherwise(0)
    return joined.withColumn("_mix_copies", copies.cast("long"))


def mix(docs: DataFrame, cap: int = 3) -> DataFrame:
    """How often each document is taken so that sources come near their targets.

    Takes ``doc_id, text, source`` (other columns are ignored); returns one row per input row: ``doc_id, size,
    source_size, target, taken, copies``. A null text has no words. Null sources are one source. The hash is that of
    doc_id, so reruns agree and repeated rows of an id share one decision; a null id hashes as the empty text. Of the
    documents that share the very hash the rest ends in, all or none are taken, whichever ends nearer. An empty table
    gives an empty result; a corpus without words has targets of zero and takes nothing.
    """
    size = _size()
    return _with_plan(docs.select("doc_id", "text", "source"), cap).select(
        "doc_id",
        size.alias("size"),
        F.col("_mix.source_size").alias("source_size"),
        F.col("_mix.target").alias("target"),
        (size * F.col("_mix_copies")).alias("taken"),
        F.col("_mix_copies").alias("copies"),
    )


def mixed(docs: DataFrame, cap: int = 3) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with all their own columns."""
    many = F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies").cast("int")))
    return _with_plan(docs, cap).withColumn("_mix_copy", many).select(*docs.columns)
