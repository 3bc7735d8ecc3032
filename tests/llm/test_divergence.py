"""Source divergence against a plain version with integers of any size, transducers against dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from tickloom.llm import divergence
from tickloom.llm.transducer import Transducer, build

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NAMES = ["lang", "source", "part", "item", "value", "rank"]


def plain(data: list[tuple], least: int = 10, top: int = 10) -> Counter:
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(brute.LOWER))) for _, text, lang, source in data]
    held, kept = Counter(), defaultdict(list)
    for lang, _, terms in rows:
        held.update({(lang, t) for t in terms})
    for (lang, t), n in held.items():
        if n >= least:
            kept[lang].append(t)
    counts = {(lang, source): Counter() for lang, source, _ in rows}
    for lang, source, terms in rows:
        counts[lang, source].update(t for t in terms if held[lang, t] >= least)

    def shares(found, terms):
        return {t: 1 + 1_000_000_000 * (found[t] + 2) // (sum(found.values()) + 2 * len(terms)) for t in terms}

    apart = lambda p, q: (p - q) ** 2 // (p + q)
    out = Counter()
    for lang in {k for k, _ in counts}:
        terms = kept[lang]
        p = {source: shares(found, terms) for (k, source), found in counts.items() if k == lang}
        q = shares(sum((f for (k, _), f in counts.items() if k == lang), Counter()), terms)
        for s, mine in p.items():
            pairs = [(sum(apart(mine[t], other[t]) for t in terms), o) for o, other in p.items() if o != s]
            best = [(apart(mine[t], q[t]), t) for t in terms if counts[lang, s][t] and mine[t] > q[t]]
            for part, found, ranks in (("pair", pairs, None), ("term", best, top)):
                found.sort(key=lambda r: (-r[0], r[1].encode()))
                out.update((lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:ranks], 1))
    return out


def corpus() -> list[tuple]:
    r = random.Random(4)
    words = ["The", "the", "ÉTÉ", "été", "naïve", "x", "a-b", "don't", "\U0001f600", "日本", "zz9top"] + [brute.invented(i, 1) for i in range(60)]
    out = []
    for i in range(240):
        lang = ["en", "de", None, "e\0n", "fr"][i % 5]
        source = [None, "s1", "s2", "só", "s\U0001f600", "s9"][r.randrange(6)]
        text = " ".join(r.choice(words) for _ in range(r.randrange(0, 50)))
        out.append((i, text if i % 17 else None, lang, source))
    return out + [(900, "rare words", "xx", "a"), (901, None, "xx", "b"), (902, "alone", "yy", "a"), out[3], out[3]] + brute.rows()


LAYOUT = "doc_id long, text string, lang string, source string, term string, slice int, place int, p string, total long, v int"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3, 4) for r in data], LAYOUT).repartition(4)


def test_equals_plain(spark):
    data = corpus()
    assert brute.keyed(divergence.source_divergence(frame(spark, data)).collect(), *NAMES) == plain(data)


@pytest.mark.parametrize("least,top", [(1, 3), (10**6, 10)])
def test_small_slices_tiles_and_strips(spark, monkeypatch, least, top):
    for name, value in {"SLICE": 16, "SIDE": 2, "STRIP": 3, "HELD": 20, "SALTS": 3}.items():
        monkeypatch.setattr(divergence, name, value)
    data = corpus()
    assert brute.keyed(divergence.source_divergence(frame(spark, data), least, top).collect(), *NAMES) == plain(data, least, top)


def test_empty(spark):
    assert divergence.source_divergence(brute.empty(spark)).collect() == []


def test_shares_never_overflow():
    counts = np.array([0, 7, 10**12, 3 * 10**12], np.int64)
    got = divergence.shares(counts, np.array([3 * 10**12 + 9] * 4, np.int64), 5)
    assert got.tolist() == [1 + 10**9 * (c + 2) // (3 * 10**12 + 19) for c in counts.tolist()]


def test_transducer_ranks_and_words():
    r = random.Random(2)
    words = sorted({bytes(r.choice(b"abc\xc3\xa9\x00") for _ in range(r.randrange(0, 9))) for _ in range(3000)})
    t = Transducer(build(words))
    assert t.words == len(words) and t.ranks(words).tolist() == list(range(len(words)))
    assert [t.word(i) for i in range(len(words))] == words
    others = [w + b"x" for w in words] + [b"\xff", b"zz"]
    assert (t.ranks(others) == -1).all() and t.ranks([]).tolist() == []


def test_transducer_is_minimal():
    endings = [b"", b"s", b"ed", b"ing"]
    words = sorted(stem + e for stem in (b"walk", b"talk", b"jump", b"want") for e in endings)
    # right languages of all prefixes that lead somewhere are the states of the minimal automaton
    right = {frozenset(w[len(p):] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert Transducer(build(words)).states == len(right)
