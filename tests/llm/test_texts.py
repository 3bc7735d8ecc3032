"""Language, media, scoring, packing, quality scores and token counts."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations
from types import SimpleNamespace

import brute
import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import compression, languages, media, packing, png, scoring, tokens, vocabulary


@pytest.fixture(scope="module")
def plain():
    return vocabulary.library(vocabulary.path("word_bpe_49k.json"))


# --- language identification -----------------------------------------------------


STEMS = {"en": "the and ing tion er of at", "de": "der und ung lich sch ein keit", "fr": "que les eau eux ment oi é", "es": "ado ción que los ez rr ñ"}


def test_languages_held_out(spark):
    data = [(i, brute.invented(i, 40, STEMS[c]), c, "s") for i in range(400) for c in [list(STEMS)[i % 4]]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    found = languages.identify(docs).collect()
    truth = {r[0]: r[2] for r in data}
    out = [r for r in found if r.held_out]
    assert {r.doc_id for r in out} == {k for k in truth if brute.crc(k, 4) == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_edges(spark):
    found = languages.identify(brute.documents(spark)).collect()
    assert len(found) == len(brute.rows())
    by_id = {r.doc_id: r for r in found}
    assert [by_id[k].lang_pred for k in (300, 301, 302, 332)] == ["und"] * 4
    assert by_id[0].lang_pred in {"en", "fr"}
    assert languages.identify(brute.empty(spark)).collect() == []
    unlabelled = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in languages.identify(unlabelled).collect()] == [("und", 0.0)]


def test_families():
    assert languages.family("pt-BR") == languages.family("es") != languages.family("de")
    assert languages.family("xx") == "xx"


# --- media columns ---------------------------------------------------------------


def test_media_round_trip(spark):
    found = media.document_sequences(brute.documents(spark)).collect()
    expected = Counter()
    for k, text, *_ in brute.rows():
        raw = (text or "").encode()
        held = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = png.encode(held)
        assert png.decode(stored) == held
        expected[k, len(raw), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(held)] += 1
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert brute.keyed(found, *names) == expected
    assert all(r.caption == f"{r.n_bytes} bytes of text" for r in found)
    assert media.document_sequences(brute.empty(spark)).collect() == []


def test_damaged_media():
    stored = bytearray(png.encode(b"x" * 128))
    stored[50] ^= 1
    with pytest.raises(ValueError):
        png.decode(bytes(stored))


def test_items_stay_in_order(spark):
    page = (
        "<html><title>T</title><script>var x='<p>';</script><p>one<br>two<img src='http://a/1.png' alt='first'>three</p>"
        "<figure><img src='sha256:abc' data-bytes='7'><video src='v.mp4'></video><figcaption>cap &amp; tion</figcaption></figure><p>end"
    )
    got = media.items(page)
    assert [x["position"] for x in got] == list(range(len(got)))
    assert [(x["kind"], x["text"], x["caption"]) for x in got] == [
        ("text", "T", None), ("text", "one", None), ("text", "two", None), ("media", None, "first"), ("text", "three", None),
        ("media", None, "cap & tion"), ("media", None, "cap & tion"), ("text", "end", None),
    ]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    known = spark.createDataFrame([("abc", "known")], "digest string, what string")
    rows = media.resolve(media.sequences(pages), known).orderBy("position").collect()
    assert [(r.page_id, r.position, r.n_bytes, r.what) for r in rows] == [(1, 3, None, None), (1, 5, 7, "known"), (1, 6, None, None)]


# --- language-model scores ---------------------------------------------------------


def test_base_scores(spark):
    docs = brute.documents(spark)
    found = scoring.language_model_scores(docs).collect()
    held = lambda k: brute.crc(k, 7) == 2
    count = Counter(w for k, t, *_ in brute.rows() if not held(k) for w in [*brute.lower_words(t), None])
    n, v = sum(count.values()), len(count)
    expected = Counter()
    for k, t, *_ in brute.rows():
        got = [*brute.lower_words(t), None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in got)
        expected[k, held(k), len(got), sum(count[w] > 0 for w in got), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 and np.isfinite(r.score) for r in found)
    assert scoring.language_model_scores(brute.empty(spark)).collect() == []


def test_scores_send_code_and_tables_once(spark, monkeypatch):
    """A function above a megabyte is broadcast as bytes: three of them held the tables, each a file on every machine."""
    sent, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(value))
    data = [(i, f"word{i % 7} and word{i % 5} rare{i}") for i in range(40)]
    assert scoring.language_model_scores(spark.createDataFrame(data, "doc_id long, text string")).count() == 40
    assert not any(isinstance(value, bytes) for value in sent) and len(sent) == 2


def test_mixing_learns(spark):
    """Held-out texts of the training texts' kind cost far fewer bits than texts of another kind."""
    data = [(i, brute.invented(i, 120)) for i in range(300)]
    data += [(1000 + i, brute.invented(i, 120, "qx zv kw jj pf yy")) for i in range(300) if brute.crc(1000 + i, 7) == 2]
    found = scoring.language_model_scores(spark.createDataFrame(data, "doc_id long, text string")).toPandas()
    out = found[found["held_out"]].copy()
    out["known"] = out["doc_id"] < 1000
    bits = out.groupby("known")["bits_per_byte"].mean()
    assert bits[True] < 2.5 < 0.5 * bits[False]


def test_code_is_complete():
    r = np.random.default_rng(0)
    hashes = [int(x) for x in r.integers(1, 2**63, 500)]
    code = scoring.Code(hashes, list(range(500, 0, -1)), 1000, 300)
    assert math.isclose(sum(2.0 ** -code.length), 1.0)
    assert code.symbols(np.array([*hashes, 12345, scoring.END], np.uint64)).tolist() == [*range(1, 501), 0, 501]


def test_tables_add_up():
    """Bit counts of parts summed by chunk are the counts of the whole."""
    texts = [brute.invented(i, 50) for i in range(20)]
    read = scoring.Texts(texts)
    hashes, n = np.unique(read.hashes, return_counts=True)
    code = scoring.Code(hashes[:100].tolist(), n[:100].tolist(), int(n[100:].sum()), 10)
    whole, a, b = scoring.Counts(), scoring.Counts(), scoring.Counts()
    whole.add(texts, code)
    a.add(texts[:7], code)
    b.add(texts[7:], code)
    for x, y, z in list(zip(whole.tables, a.tables, b.tables, strict=True))[: scoring.WORD_TABLES]:
        assert (x == y + z).all() and x.sum()
    assert [w.decode() for w in read.words(np.arange(len(read.hashes)))][:50] == brute.lower_words(texts[0])


def small_model(texts):
    """A code, tables and scorer learnt from ``texts``, without Spark."""
    read = scoring.Texts(texts)
    hashes, n = np.unique(read.hashes, return_counts=True)
    order = np.argsort(-n, kind="stable")
    top = order[: len(order) // 2]
    code = scoring.Code(hashes[top].tolist(), n[top].tolist(), int(n.sum() - n[top].sum()), int((n == 1).sum()))
    counts = scoring.Counts()
    counts.add(texts, code)
    rows = [(at, zlib.compress(scoring._halved(np.frombuffer(zlib.decompress(raw), "<u4")).astype("<u4").tobytes())) for at, raw in counts.rows()]
    return scoring.Model(code, rows), counts, dict(zip(hashes.tolist(), n.tolist(), strict=True))


def test_equal_tokens_are_scored_once(monkeypatch):
    """300 copies in a block took 300 times the mixer's bits of one copy."""
    text = " ".join(brute.invented(i, 60) for i in range(3)) + " onlyhere"
    model, _, known = small_model([text] * 300)
    sent = scoring.Sent(SimpleNamespace(value=model.code), SimpleNamespace(value=model.tables))
    uses = pa.table({"word": np.array(list(known), np.uint64).view(np.int64), "count": list(known.values())})
    bits, costs = [], scoring.Mixer.costs
    monkeypatch.setattr(scoring.Mixer, "costs", lambda self, inputs, gate, sign: bits.append(len(sign)) or costs(self, inputs, gate, sign))

    def scored(copies):
        bits.clear()
        docs = pa.record_batch({"doc_id": list(range(copies)), "held_out": [False] * copies, "text": [text] * copies})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, docs.schema) as stream:
            stream.write_batch(docs)
        found = scoring._score_block(sent, sum(known.values()), len(known))(pa.table({"raw": [out.getvalue().to_pybytes()]}), uses)
        return found.column("score").to_pylist(), sum(bits)

    (one,), bits_of_one = scored(1)
    many, bits_of_many = scored(300)
    assert bits_of_many == bits_of_one > 0
    assert len(many) == 300 and np.allclose(many, one)


def test_equal_tokens_count_and_cost_as_many():
    """What is worked out once gives the counts and costs of each token by itself."""
    texts = [brute.invented(i % 9, 40) + f" the the the rare{i % 5}" for i in range(30)]
    model, counts, _ = small_model(texts)
    code, read = model.code, scoring.Texts(texts)
    symbols = code.symbols(read.hashes)
    keys = scoring.token_keys(symbols, read.starts, code.size)
    for i in range(scoring.WORD_TABLES):
        token, flat, bit = code.bits(symbols)
        slots = scoring.word_slots(scoring.contexts(keys, code.size)[i], token, code.hashed[flat])
        assert (counts.tables[i] == np.bincount(slots * 2 + bit, minlength=len(counts.tables[i]))).all()
    spelled = sorted(set(read.words(np.flatnonzero(symbols == 0))))
    for i in range(scoring.SPELL_TABLES):
        expected = np.zeros(len(counts.tables[scoring.WORD_TABLES + i]), np.int64)
        for _, slots, bit in scoring.Letters(scoring.letter_keys(spelled)[1]).parts():
            np.add.at(expected, slots[i] * 2 + bit, 1)
        assert expected.sum() and (counts.tables[scoring.WORD_TABLES + i] == expected).all()
    scorer = scoring.Scorer(model)
    scorer.learn_words(read, symbols)
    scorer.learn_letters(spelled)
    for own in (True, False):
        assert np.allclose(scorer.word_costs(keys, own)[::7], [scorer.word_costs(k[None], own)[0] for k in keys[::7]], rtol=1e-5)
        assert np.allclose(scorer.letter_costs(spelled, own), [scorer.letter_costs([w], own)[0] for w in spelled], rtol=1e-5)


def test_mixer_learns_a_bit_as_often_as_it_came():
    rng = np.random.default_rng(5)
    inputs, gate, bit = [rng.normal(size=200).astype(np.float32) for _ in range(3)], rng.integers(0, 16, 200), rng.integers(0, 2, 200)
    times = rng.integers(1, 9, 200)
    once, repeated = (scoring.Mixer(16, [1.0, 0.2, 0.6]) for _ in range(2))
    once.learn(inputs, gate, bit, times.astype(np.float32))
    repeated.learn([np.repeat(x, times) for x in inputs], np.repeat(gate, times), np.repeat(bit, times))
    for name in ("curve", "ones", "all", "weights"):
        assert np.allclose(getattr(once, name), getattr(repeated, name), rtol=1e-4, atol=1e-5)


# --- packing -----------------------------------------------------------------------


def test_pack_round_trip(spark, plain):
    docs = brute.documents(spark)
    found = packing.pack(docs).collect()
    expected = Counter()
    for k, t, *_ in brute.rows():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        for i, at in enumerate(range(0, len(ids), 8192)):
            expected[k, i, at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192])] += 1
    assert brute.keyed(found, "doc_id", "piece", "start", "length", "ids_crc32") == expected
    by_sequence: dict[int, list] = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(brute.empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_all_and_fill(seed):
    r = random.Random(seed)
    size = r.choice([16, 100, 2048])
    sizes = Counter(min(size, max(1, int(r.lognormvariate(math.log(size / 4), 1)))) for _ in range(r.choice([5, 300, 20_000])))
    made = packing.plan(dict(sizes), size)
    used, sequences, full = Counter(), 0, 0
    for parts, times in made:
        total = sum(length * each for length, each in parts)
        assert total <= size and times > 0
        sequences += times
        full += times * (total == size)
        for length, each in parts:
            used[length] += each * times
    assert used == sizes
    least = -(-sum(k * n for k, n in sizes.items()) // size)
    assert sequences <= least * 1.05 + 2
    slots = packing.Slots(made, size)
    lengths = np.repeat(np.array(list(sizes)), list(sizes.values()))
    ranks = np.concatenate([np.arange(n) for n in sizes.values()])
    sequence, offset = slots.place(lengths, ranks)
    assert len({*zip(sequence.tolist(), offset.tolist(), strict=True)}) == len(lengths) and sequence.max() < sequences


def test_complements_are_exact():
    n = [0] * 101
    for length in (7, 13, 30, 50):
        n[length] = 2
    index = packing.Complements(n)
    assert index.filling(50, 50) == (50,)
    assert sorted(index.filling(30, 43)) == [13, 30]
    assert sorted(index.filling(50, 33)) == [7, 13, 13]
    assert index.filling(50, 49) is None


def test_mixers_of_blocks_add_up():
    rng = np.random.default_rng(3)
    parts = [([rng.normal(size=500).astype(np.float32) for _ in range(3)], rng.integers(0, 16, 500), rng.integers(0, 2, 500)) for _ in range(2)]
    first, second, both = (scoring.Mixer(16, [1.0, 0.2, 0.6]) for _ in range(3))
    first.learn(*parts[0])
    second.learn(*parts[1])
    both.add(first.sums() + second.sums())
    assert np.allclose(both.all.sum(), 16 * 33 * 20 + 1000) and np.allclose(both.curve, first.curve + second.curve - np.eye(3) * 200)
    again = scoring.Mixer(16, [1.0, 0.2, 0.6])
    again.add(first.sums())
    assert np.allclose(again.weights, first.weights, atol=1e-5) and np.allclose(again.ones, first.ones)


def test_mixer_learns_from_every_bit():
    texts = [f"the cat {i} sat on the mat {i % 7}" for i in range(60)]
    read = scoring.Texts(texts)
    hashes, n = np.unique(read.hashes, return_counts=True)
    code = scoring.Code(hashes.tolist(), n.tolist(), 1, 0)
    scorer = scoring.Scorer(scoring.Model(code, []))
    symbols = code.symbols(read.hashes)
    scorer.learn_words(read, symbols)
    bits = len(code.bits(symbols)[0])
    assert (scorer.of_words.all - 20).sum() == bits


def test_equal_texts_score_equal_in_any_block(spark):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 == 2]
    learnt = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 != 2]
    text = "the quick brown fox meets a new zyxwv"
    # one partition with training texts, one with few, one without
    rows = [(i, f"the fox number {i % 50} meets a quick dog {i}") for i in learnt[:600]] + [(ids[0], text)]
    parts = [rows, [(learnt[700], "a dog"), (ids[1], text)], [(ids[2], text)]]
    df = spark.createDataFrame(spark.sparkContext.parallelize(parts, 3).flatMap(lambda x: x), "doc_id long, text string")
    found = {r.doc_id: r.score for r in scoring.language_model_scores(df).collect()}
    assert found[ids[0]] == found[ids[1]] == found[ids[2]]


# --- quality scores ----------------------------------------------------------------


def test_compression_scores(spark):
    good = [(i, brute.invented(i, 80), 1) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "###" for w in brute.invented(i, 80, "zz qu xi").split()), 0) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in good + bad] + [(5000, ""), (5001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in good + bad] + [(None, 1), (7, None), (9999, 0)], "doc_id long, quality int")
    found = {r.doc_id: r for r in compression.quality_scores(docs, labels).collect()}
    truth = {k: y for k, _, y in good + bad}
    out = [found[k].predicted == y for k, y in truth.items() if brute.crc(k, 3) == 1]
    assert np.mean(out) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found.values())
    assert {r.held_out for k, r in found.items() if brute.crc(k, 3) == 1} == {True}


def test_compression_without_labels(spark):
    docs = brute.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in compression.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert len({r.score for r in compression.quality_scores(docs, one).collect()}) == 1
    assert compression.quality_scores(brute.empty(spark), one).collect() == []


# --- token counts ------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    starts = tokens.starts_of(vocabulary.path(name))
    found = tokens.token_counts(brute.documents(spark), name, huge=2000).collect()
    expected = Counter()
    for k, t, *_ in brute.rows():
        n = len(starts([t or ""])[0])
        expected[k, len((t or "").encode()), n, n > 2048] += 1
    assert brute.keyed(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert tokens.token_counts(brute.empty(spark), name).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_chunks_give_the_whole(name):
    starts = tokens.starts_of(vocabulary.path(name))
    texts = [brute.invented(7, 900), "x" * 3000 + " abc " + "y" * 900 + " " * 700 + "é" * 800 + "<|endoftext|>" * 60 + "\n\n z", "a\n" * 2000]
    for text in texts:
        for chunk, overlap in ((500, 16), (300, 8), (1000, 64)):
            assert tokens.count_tokens(text, starts, chunk, overlap) == len(starts([text])[0])


def test_word_memory_forgets(plain):
    memory = vocabulary.WordIds(vocabulary.path("word_bpe_49k.json"), limit=50)
    texts = [t or "" for _, t, *_ in brute.rows()] + ["İstanbul ΣΑΣ ﬁne ǅ it's, we'll!! a.b.c <|ENDOFTEXT|> x<|startoftext|>y Å é ́e ٣ 12"]
    got = [np.frombuffer(b"".join(ids), "<u4").tolist() for t in texts for ids in memory.ids([t])]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_complements_beside_lengths_in_use():
    index = packing.Complements([0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0])
    assert index.filling(5, 7) == (4, 3) and index.filling(5, 9) == (4, 3, 2) and index.filling(4, 8) == (5, 3)
    assert index.filling(5, 10) is None
    r = np.random.default_rng(3)
    for _ in range(200):  # as all combinations say, whatever was asked before
        n = r.integers(0, 3, 25).tolist()
        n[0] = 0
        index = packing.Complements(n + [0] * 40)
        for _ in range(20):
            length, gap = int(r.integers(1, 25)), int(r.integers(1, 40))
            if not n[length]:
                continue
            have = [x for x in range(25) for _ in range(min(3, n[x] - (x == length)))]
            any_fit = any(sum(c) == gap for k in (1, 2, 3) for c in combinations(have, k))
            found = index.filling(length, gap)
            assert (found is not None) == any_fit and (found is None or sum(found) == gap)


def test_a_long_labelled_text_counts_whole(spark):
    """Calibration sees texts of over 100 KB as they are; dictionaries take what the parameter says."""
    good, bad = brute.invented(1, 25_000), brute.invented(2, 25_000, "zz qu xi wo").upper()
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(24)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    model = compression.learn(docs, labels, material=200_000)
    sizes = compression.Sizes(model.good, model.bad)
    whole = [sizes.features(t.encode()) for t in (good, bad)]
    assert len(good) > 100_000 and np.allclose(model.mean, np.mean(whole, axis=0), rtol=1e-12)
    assert model.scorer()(good.encode()) > 0.5 > model.scorer()(bad.encode())
    raw = bytes(range(256)) * 800
    assert b"".join(compression.material_of(raw, len(raw))) == raw and len(compression.material_of(raw, 8192)) == 4
