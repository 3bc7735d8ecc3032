"""The pipeline's stages one by one, and as a whole, against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import brute
import corpus_pipeline
import pytest

# names that the operators behind the stages use themselves
INTERNAL = ["_language", "_lines", "_row", "_mix", "_mix_source", "_mix_copies", "_marked", "kept_id", "_kept", "other column"]


@pytest.fixture(scope="module", params=[False, True])
def docs(spark, request):
    plain = brute.documents(spark, clash=request.param)
    if not request.param:
        return plain
    from pyspark.sql import functions as F

    return plain.withColumns({c: F.lit(c) for c in INTERNAL})


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def same_shape(out, docs):
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    for name in INTERNAL:
        if name in out.columns:
            assert {r[name] for r in out.select(f"`{name}`").collect()} == {name}


def letter(text):
    return any(map(str.isalpha, text or ""))


def test_language_stage_drops_only_texts_without_letters(spark, docs):
    out = stage("language_id")(spark, docs, "")
    same_shape(out, docs)
    found = out.collect()
    assert brute.keyed(found, "doc_id", "text") == Counter((r[0], r[1]) for r in brute.rows() if letter(r[1]))
    assert {r.lang for r in found} == {"en", "fr"}  # null codes are filled with what the text is identified as


def test_language_stage_without_anything_to_learn_from(spark):
    rows = [(k, t, None, s, 0) for k, t, _, s in brute.rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage("language_id")(spark, docs, "").collect()
    assert brute.keyed(out, "doc_id", "text", "lang") == Counter((r[0], r[1], None) for r in brute.rows() if letter(r[1]))


def test_line_stage(spark, docs):
    out = stage("line_dedup")(spark, docs, "")
    same_shape(out, docs)
    want = Counter((k, None if t is None else kept, None if t is None else len(kept)) for k, t, _, _, kept in brute.kept_lines(brute.rows()))
    assert brute.keyed(out.collect(), "doc_id", "text", "n_chars") == want


def test_near_stage(spark, docs):
    out = stage("near_dedup")(spark, docs, "")
    same_shape(out, docs)
    kept = {k for k, _, _, keep in brute.near_components(brute.rows()) if keep}
    assert brute.keyed(out.collect(), "doc_id", "text") == Counter((r[0], r[1]) for r in brute.rows() if r[0] in kept)


def test_mixing_stage(spark, docs):
    out = stage("mixing")(spark, docs, "")
    same_shape(out, docs)
    taken = Counter()
    for k, _, _, _, words in brute.mixture(brute.rows()):
        taken[k] += words
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(brute.words(r.text))
        assert brute.words(r.text)
    assert +got == +taken


def test_packing_stage(spark, docs):
    out = stage("best_fit_packing")(spark, docs, "").collect()
    ids = Counter(r[0] for r in brute.rows())
    assert Counter(r.doc_id for r in out if r.piece == 0) == ids
    room = Counter()
    for r in out:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048


def test_order_and_shape(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mixing", "best_fit_packing"]
    rows = brute.empty(spark)
    for _, run in corpus_pipeline.STAGES:
        rows = run(spark, rows, "")
    assert rows.collect() == []


def test_whole_run_against_plain_stages(spark, tmp_path):
    """All stages in a row: what each keeps is what plain Python keeps of the stage before."""
    r = random.Random(5)
    data = [(i, brute.invented(i, 70), "en" if i % 3 else None, f"s{i % 3}") for i in range(40)]
    data += [(100 + i, data[i][1], "en", "s1") for i in range(5)]  # exact copies: every line is an earlier document's
    data += [(200 + i, brute.near(data[10 + i][1], i, 2), "en", "s2") for i in range(5)]
    data += [(300, "12 345 --", "en", "s0"), (301, None, "en", "s0"), (302, "", None, None)]
    data += [(310 + i, f"One shared long line\n{brute.invented(310 + i, 40)}", "en", None) for i in range(4)]
    r.shuffle(data)
    layout = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*d, len(d[1] or "")) for d in data], layout).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    rows = [d for d in data if letter(d[1])]
    rows = [(k, kept, *d[2:]) for (k, _, _, _, kept), d in zip(brute.kept_lines(rows), rows)]
    assert sum(d[1] == "" for d in rows) == 5
    keep = {k for k, _, _, kept in brute.near_components(rows) if kept}
    rows = [d for d in rows if d[0] in keep]
    copies = Counter()
    for k, size, _, _, taken in brute.mixture(rows):
        if size:
            copies[k] += taken // size
    assert Counter(p.doc_id for p in found if p.piece == 0) == +copies
