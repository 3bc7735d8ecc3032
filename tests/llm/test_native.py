"""Quality rules, mixing and line dedup against plain versions, on whole edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import brute
import pytest

from tickloom.llm import lines, mixing, rules


def counts(text):
    w = brute.words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if brute.words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.fixture(scope="module")
def repetitive(spark):
    data = brute.rows() + [
        (400, "the same words again and again here now " * 6, "en", "s0"),
        (401, "a b c d e f g h i a b c d e f g h z", "en", "s0"),
        (402, "\n".join(["a line", "a line", "", "", " ", "a  line"] * 3), "en", "s0"),
    ]
    return data, spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")


def test_rule_counts(repetitive):
    data, docs = repetitive
    found = rules.quality(docs).collect()
    expected = Counter((k, *counts(text)) for k, text, *_ in data)
    assert brute.keyed(found, "doc_id", *rules.COUNTS) == expected
    for r in found:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and (not failed or not r.kept)
        assert r.kept == (not failed and r.posterior >= 0.5)


def test_posterior_separates_kinds(spark):
    clean = [(i, brute.invented(i, 80)) for i in range(60)]
    junk = [(100 + i, " ".join(w + "###" for w in brute.invented(i, 80).split())) for i in range(8)]
    junk += [(200 + i, brute.invented(i, 80).upper() + "!!") for i in range(8)]
    found = {r.doc_id: r.kept for r in rules.quality(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert all(found[k] for k, _ in clean) and not any(found[k] for k, _ in junk)


def test_fit_equals_row_by_row():
    patterns = [{"a": -1, "b": 0, "n": 7}, {"a": 0, "b": 1, "n": 90}, {"a": 0, "b": 0, "n": 5}]
    one_by_one = [{**p, "n": 1} for p in patterns for _ in range(p["n"])]
    a, b = rules.fit(patterns, ["a", "b"]), rules.fit(one_by_one, ["a", "b"])
    assert a[0] == pytest.approx(b[0]) and a[1]["a"][-1] == pytest.approx(b[1]["a"][-1])


def test_rules_on_nothing(spark):
    assert rules.quality(brute.empty(spark)).collect() == []


def test_mix(spark):
    found = mixing.mix(brute.documents(spark)).collect()
    got = sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in found)
    assert got == sorted((str(k), s, t, round(g, 6), n) for k, s, t, g, n in brute.mixture(brute.rows()))


def test_mix_keeps_to_its_caps(spark):
    data = [(i, brute.invented(i, 5 + i % 40), None, "big" if i % 3 else f"small{i % 9}") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    found = mixing.mix(docs).toPandas()
    assert (found["taken"] <= 3 * found["size"]).all()
    for _, g in found.groupby("source_size"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(found.itertuples(index=False)) == sorted(again.itertuples(index=False))
    rows = mixing.mixed(docs).groupBy("doc_id").count().collect()
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in rows} == copies


def test_mix_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0.0, 0)] * 3
    assert mixing.mix(brute.empty(spark)).collect() == []


def test_lines(spark):
    found = lines.line_report(brute.documents(spark)).collect()
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    expected = Counter((k, n, d, sha(t)) for k, _, n, d, t in brute.kept_lines(brute.rows()))
    assert brute.keyed(found, "doc_id", "n_lines", "n_dropped", "kept_sha256") == expected


def test_lines_keep_columns_and_nulls(spark):
    docs = brute.documents(spark)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    expected = Counter((k, None if text is None else kept) for k, text, _, _, kept in brute.kept_lines(brute.rows()))
    assert brute.keyed(out.collect(), "doc_id", "text") == expected
    assert lines.dedup_lines(brute.empty(spark)).collect() == []


def test_bitmaps_are_runs(spark):
    text = "\n".join(f"line number {i}" for i in range(50))
    data = [(1, "\n".join(f"line number {i}" for i in (3, 4, 5, 9, 40, 41))), (2, text)]
    marks = lines.keep_bitmaps(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert [(r.doc, [tuple(x) for x in r.drop_runs]) for r in marks] == [(2, [(3, 3), (9, 1), (40, 2)])]


SCRIPTS = {
    "arabic": ["كتاب", "مدرسة", "بيت،", "شمس", "قمر", "نهر", "جبل", "طريق", "سماء.", "بحر", "ولد", "بنت؟"],
    "hindi": ["किताब", "विद्यालय", "घर।", "सूरज", "चाँद", "नदी", "पहाड़", "रास्ता", "आकाश", "समुद्र", "क्ष", "हिन्दी"],
    "persian": ["می\u200cروم", "خانه", "کتاب\u200cها", "روز", "شب", "آب", "نان", "دست", "چشم", "سر", "پا", "دل"],
    "chinese": ["我们", "今天", "学习。", "天气", "很好，", "老师", "学生", "书", "水", "火", "山", "朋友"],
    "hebrew": ["ספר", "בית", "שמש", "ירח.", "נהר", "הר", "דרך", "שמים", "ים", "ילד", "ילדה", "עץ"],
}


@pytest.mark.parametrize("many", [1, 40])
def test_scripts_without_case_are_clean_in_any_number(spark, many):
    import random

    english = [(i, brute.invented(i, 120)) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###" for w in brute.invented(i, 80).split())) for i in range(20)]
    data, at = english + junk, 2000
    for words in SCRIPTS.values():
        for k in range(many):
            r = random.Random(at + k)
            fresh = ["".join(r.sample(words, 2)).replace(".", "").replace("،", "") for _ in range(40)]
            data.append((at + k, " ".join(r.choice(words + fresh) for _ in range(150))))
        at += 100
    found = {r.doc_id: r.kept for r in rules.quality(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(kept for k, kept in found.items() if k < 1000 or k >= 2000) and not any(found[k] for k, _ in junk)


def test_verdicts_equal_a_plain_version(repetitive):
    """Votes, expectation-maximisation over single documents, and the verdict, all in plain Python."""
    data, docs = repetitive
    found = rules.quality(docs).collect()
    names, votes = list(rules._votes()), []
    for _, text, *_ in data:
        n, chars, symbols, dup, often = counts(text)
        w, text = brute.words(text), text or ""
        lines = sum(bool(brute.words(x)) for x in text.split("\n"))
        plain, distinct = sum(bool(re.fullmatch(r"[^\W\d_][^\W\d_A-ZÉÇ]*[.,;:]?", x)) for x in w), len(set(w))
        caps, spread = sum("A" <= c <= "Z" for c in text), min(n, 200)
        votes.append({
            "length": -(n < 20), "repetition": -(100 * often > 30 * n), "symbols": -(100 * symbols > 4 * chars),
            "lines": -(100 * dup > 30 * lines), "capitals": -(100 * caps > 40 * chars),
            "word_length": -(chars < 2 * n or chars > 15 * n), "variety": -(n >= 20 and 100 * distinct < 20 * spread),
            "prose": 1 if n and 100 * plain >= 85 * n and 100 * distinct >= 30 * spread else -(100 * plain < 60 * n),
        })
    prior, ratios = rules.fit([{**v, "n": 1} for v in votes], names)
    want = Counter()
    for (k, text, *_), v in zip(data, votes, strict=True):
        n, _, _, _, often = counts(text)
        odds = prior + sum(ratios[r][v[r]] for r in names)
        want[(k, not (n < 20 or 100 * often > 30 * n) and odds >= 0)] += 1
    assert brute.keyed(found, "doc_id", "kept") == want
