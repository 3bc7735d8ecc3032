"""Near duplicates and components against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pytest

from tickloom.llm import neardup
from tickloom.llm.components import components
from tickloom.llm.shingles import Shingles


def check(docs, data):
    found = neardup.near_duplicates(docs).collect()
    assert brute.keyed(found, "doc_id", "n_shingles", "component_id", "kept") == Counter(brute.near_components(data))


def test_near_duplicates(spark):
    check(brute.documents(spark), brute.rows())
    assert neardup.near_duplicates(brute.empty(spark)).collect() == []


@pytest.mark.parametrize("many", [1, 2048])
def test_shared_passages_and_chains(spark, monkeypatch, many):
    """Passages that many documents share, chains of near copies, copies whose smallest member is no neighbour of all."""
    monkeypatch.setattr(neardup, "MANY", many)
    passage = brute.invented(1000, 60)
    data = [(i, passage + " " + brute.invented(i, 40)) for i in range(40)]
    text = brute.invented(2000, 120)
    for i in range(12):  # each differs from the one before by some words
        text = brute.near(text, i, 2)
        data.append((500 + i * 7 % 12, text))
    data += [(700 + i, data[5][1]) for i in range(3)]
    random.Random(3).shuffle(data)
    check(spark.createDataFrame(data, "doc_id long, text string"), data)


def test_one_id_with_two_texts(spark):
    a, b = brute.invented(1), brute.invented(2)
    data = [(5, a), (9, a), (5, b), (7, b)]
    check(spark.createDataFrame(data, "doc_id long, text string"), data)


def test_signature_agreement_estimates_similarity():
    r = np.random.default_rng(5)
    pool = r.integers(0, 2**63, 3000, dtype=np.uint64)
    x, y = np.unique(pool[:2400]), np.unique(pool[600:])
    got = (neardup.signature(x) == neardup.signature(y)).mean()
    assert abs(got - 0.6) < 0.12
    assert len(set(neardup.band_keys(neardup.signature(x)))) == neardup.BANDS


def test_shingles_are_distinct_word_runs():
    s = Shingles()
    for _, text, *_ in brute.rows():
        assert len(s.distinct(text or "")) == len(brute.shingles(text))


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {n: n for pair in links for n in pair}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        u, v = sorted((root(a), root(b)))
        parent[v] = u
    found = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: root(n) for pair in links for n in pair if pair[0] != pair[1]}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def crowd(spark, size):
    """One bucket of unlike classes, of which only the first and the last are alike; no other band is shared."""
    r = np.random.default_rng(5)
    sketches = r.integers(0, 2**16, (size, 176)).astype("<u2")
    sketches[-1] = sketches[0]
    full = [(i, 100, bytearray(s.tobytes()), [1, 10 + i]) for i, s in enumerate(sketches)]
    full = spark.createDataFrame(full, "node long, n long, sketch binary, bands array<long>")
    rows = spark.createDataFrame([(1, i) for i in range(size)], "key long, node long")
    return rows, full, spark.createDataFrame([], "node long, component long")


def sets_of(spark, size):
    """Sets whose links are those of ``crowd``: the last set is the first one but for one shingle."""
    r = np.random.default_rng(6)
    sets = [r.integers(0, 2**62, 100).tolist() for _ in range(size)]
    sets[-1] = sets[0][:-1] + [7]
    return spark.createDataFrame(list(enumerate(sets)), "node long, set array<long>")


@pytest.mark.parametrize("size,many", [(100, 2048), (1300, 300), (1300, 2048)])
def test_only_shared_band_is_a_large_bucket(spark, monkeypatch, size, many):
    monkeypatch.setattr(neardup, "MANY", many)
    found = neardup._links_apart(*crowd(spark, size), lambda nodes: sets_of(spark, size)).collect()
    assert {(r.a, r.b) for r in found} == {(size - 1, 0)}


def test_large_bucket_is_cut_into_bounded_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MANY", 50)
    tiles = Counter(r.tile for r in neardup._tiles(*crowd(spark, 1000)).collect())
    assert len(tiles) == 210 and max(tiles.values()) < 200


@pytest.mark.parametrize("alike", [0.9, 0.7])
def test_rows_stay_in_proportion(spark, monkeypatch, alike):
    """Texts of one bucket, all near each other or all just not: neither stage returns a row per pair."""
    size = 1500
    rows, full, found = crowd(spark, size)
    sketch = full.first().sketch
    full = spark.createDataFrame([(i, 100, sketch, [1]) for i in range(size)], full.schema)
    common, r = list(range(1000)), np.random.default_rng(1)
    shared = int(200 * alike / (1 + alike))  # of 100 each, so that similarity is about ``alike``
    sets = [(i, common[:shared] + r.integers(10**6, 2**60, 100 - shared).tolist()) for i in range(size)]
    sets = spark.createDataFrame(sets, "node long, set array<long>")
    members = neardup._in_tiles(neardup._tiles(rows, full, found), neardup._may_link, neardup._MEMBER)
    assert members.count() == size
    links = neardup._links_apart(rows, full, found, lambda nodes: sets).collect()
    assert len(links) == (size - 1 if alike > 0.75 else 0)


def test_a_band_has_four_permutations():
    rows = neardup.band_rows(np.tile(np.arange(neardup.PERMUTATIONS), 2))
    assert rows.shape == (neardup.BANDS, neardup.ROWS) and all(len(set(r)) == neardup.ROWS for r in rows.tolist())
