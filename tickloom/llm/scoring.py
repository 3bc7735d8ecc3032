"""Language-model scores of texts by online logistic context mixing.

A text is the sequence of its lower-cased words and an end. Frequent words are symbols of a Huffman code. Other words are
an escape, then a word of the training texts by its share of them, or the sign of a new word and its bytes. Every bit of
the code and of new words is predicted in several contexts; the bit counts of a context lie in a hashed table of fixed
size, summed over all training texts. A mixer combines the predictors (mixer.py). In every task it learns online from
each bit of the training texts, which are predicted as if they had not been counted themselves; what all tasks have
learnt is summed to one mixer, and that one scores every text. Tokens that agree in all their contexts have the same
predictions: among many tokens they are worked out once, and weigh as often as they come.

The base score is exact: counts of all words, joined back to blocks of about eight megabytes of text.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import SPACES, held_out, small
from tickloom.llm.mixer import Mixer, confidence, ratio, stretch, taken
from tickloom.session import written

BLOCK = 8 << 20  # bytes of text scored together
WORDS = 65_536  # words of the code at most
FREQUENT = 256  # the most frequent words tell the language
WORD_BITS, SPELL_BITS = 20, 18  # slots of hashed tables, as powers of two
WORD_TABLES, SPELL_TABLES = 2, 4
CHUNK = 1 << 13  # counts in a row of a table that is summed
TOKENS, LETTERS = 8192, 10_240  # tokens and bytes worked on at a time: their arrays stay in the processor's cache
TOGETHER = 1 << 21  # tokens among which equal ones are worked out once
END = 0x5851F42D4C957F2D  # stands for the end of a text among word hashes
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint32(0)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint32)) * _M1
        h = h ^ (h >> np.uint32(15))
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each comes."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return keys[first], np.diff(first, append=len(keys))


def _shuffled(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_distinct`` in an order that has nothing to do with the keys."""
    keys, times = _distinct(keys * np.uint64(_BASE))
    return keys * np.uint64(_INVERSE), times


class Code:
    """A Huffman code of the escape (symbol 0) and known words, most frequent first from symbol 1."""

    def __init__(self, hashes: list[int], counts: list[int], others: int, once: int) -> None:
        """``others``: training tokens of words without a symbol; ``once``: how many of those words come once."""
        self.others, self.new = max(others, 1), min(max(once / max(others, 1), 1e-3), 0.999)
        if END not in hashes:
            hashes, counts = [*hashes, END], [*counts, 1]
        weights = [max(others, 1), *counts]
        n = self.size = len(weights)
        self.key = np.array([0, *hashes], np.uint64)
        # a direct table of symbols by the upper bits of the hash; words that share a cell are searched for
        self.cell = np.zeros(1 << 20, np.int32)
        cells = (self.key >> np.uint64(44)).astype(np.int64)
        self.cell[cells[:0:-1]] = np.arange(n - 1, 0, -1)
        late = np.flatnonzero(self.cell[cells[1:]] != np.arange(1, n)) + 1
        self.late = late[np.argsort(self.key[late])].astype(np.int32)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8)
        self.zero, self.one = np.zeros(n, np.float32), np.zeros(n, np.float32)
        for node in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = node
            side[y] = 1
            self.zero[node - n], self.one[node - n] = a, b
            heapq.heappush(heap, (a + b, node))
        root, nodes, bits, self.length = 2 * n - 2, [], [], np.zeros(n, np.int64)
        for leaf in range(n):
            at, path = leaf, []
            while at != root:
                path.append((parent[at] - n, side[at]))
                at = parent[at]
            self.length[leaf] = len(path)
            nodes += [p for p, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
        node, self.bit = np.array(nodes, np.uint32), np.array(bits, np.uint8)
        self.hashed = node * _M1
        p, odds = stretch(self.one, self.zero, np.float32(0.5), 0.8)
        self.p, self.odds = p[node], odds[node]
        self.start = np.cumsum(self.length) - self.length

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        found = taken(self.cell, (hashes >> np.uint64(44)).astype(np.intp))
        found[taken(self.key, found.astype(np.intp)) != hashes] = 0
        if len(self.late):
            missed = np.flatnonzero(found == 0)
            keys = self.key[self.late]
            at = np.minimum(np.searchsorted(keys, hashes[missed]), len(keys) - 1)
            found[missed] = np.where(keys[at] == hashes[missed], self.late[at], 0)
        return found

    def bits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token index, place in the code and bit of every code bit of a symbol sequence."""
        length = self.length[symbols]
        token = np.repeat(np.arange(len(symbols)), length)
        flat = taken(self.start[symbols] - (np.cumsum(length) - length), token)
        flat += np.arange(len(token))
        return token, flat, taken(self.bit, flat)


_IN_WORD = bytes(b not in SPACES.encode() for b in range(256))


class _Powers:
    """Powers of the base of word hashes and of its inverse, modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            cls.up, cls.down = (np.full(size, x, np.uint64) for x in (_BASE, _INVERSE))
            cls.up[0] = cls.down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(cls.up), np.multiply.accumulate(cls.down)


class Texts:
    """Tokens of texts, one after the other: word hashes with the end behind each text.

    A word's hash is a polynomial of its lower-cased bytes modulo 2**64, taken from sums over the joined texts.
    """

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode().lower() for t in texts]
        self.buffer = b"\n".join([*raw, b""])
        byte = np.frombuffer(self.buffer, np.uint8)
        _Powers.to(len(byte) + 1)
        word = np.frombuffer(self.buffer.translate(_IN_WORD), bool)
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate([[0], edge])
        first, last = edge[::2], edge[1::2]
        sums = byte + np.uint64(1)
        sums *= _Powers.up[: len(byte)]
        np.cumsum(sums, out=sums)
        hashes = sums[last - 1] - np.where(first > 0, sums[first - 1], np.uint64(0))
        hashes *= _Powers.down[first]
        hashes ^= (last - first).astype(np.uint64) << np.uint64(56)
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        words = np.diff(np.searchsorted(first, ends), prepend=0)
        text = np.repeat(np.arange(len(texts)), words)
        self.lengths = words + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(first)) + text
        self.hashes = np.full(len(first) + len(texts), END, np.uint64)
        self.hashes[place] = hashes
        self.first, self.last = np.zeros((2, len(self.hashes)), np.int64)
        self.first[place], self.last[place] = first, last

    def words(self, tokens: np.ndarray) -> list[bytes]:
        return [self.buffer[a:b] for a, b in zip(self.first[tokens].tolist(), self.last[tokens].tolist(), strict=True)]

    def bytes(self) -> np.ndarray:
        """Bytes of each text's words, and one behind each token."""
        return np.add.reduceat(self.last - self.first + 1, self.starts)


BEFORE, LAST = 26, 17  # bits of a token's key below the word before, and below the last frequent word
_OF_BEFORE, _OF_LAST = (np.uint64(2**64 - 1 - ((1 << BEFORE) - (1 << LAST))), np.uint64((1 << BEFORE) - 1))  # what a table needs of a key


def token_keys(symbols: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A number for each token that holds all its model sees: the word before, the last frequent word, and its symbol."""
    n = len(symbols)
    first = np.zeros(n, bool)
    first[starts] = True
    one = np.concatenate([[size], symbols[:-1]])
    one[first] = size
    frequent = (one > 0) & (one <= FREQUENT) & ~first
    last = taken(np.where(frequent, one, 0), np.maximum.accumulate(np.where(frequent | first, np.arange(n), 0)))
    return ((one << BEFORE) | (last << LAST) | symbols).astype(np.uint64)


def key_symbols(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << LAST) - 1)).astype(np.int64)


def contexts(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """Hashes of each token's contexts: the word before, and the last frequent word."""
    last = (keys >> np.uint64(LAST)) & np.uint64((1 << (BEFORE - LAST)) - 1)
    return [_mix(keys >> np.uint64(BEFORE), 1), _mix(np.where(last, last, np.uint64(size)), 2)]


def word_slots(context: np.ndarray, token: np.ndarray, node: np.ndarray) -> np.ndarray:
    slots = taken(context, token)
    slots ^= node
    slots *= _M2
    slots >>= np.uint32(32 - WORD_BITS)
    return slots.astype(np.intp)


def letter_keys(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word index, and a number that holds all its model sees, of each byte of the words and of a space behind each: the
    byte and five before it in the word."""
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
    byte = np.frombuffer(b" ".join(spelled) + b" ", np.uint8) if spelled else np.zeros(0, np.uint8)
    place = np.arange(len(byte)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = byte.astype(np.uint64)
    for k in range(1, 6):
        b = np.concatenate([np.zeros(min(k, len(byte)), np.uint8), byte[:-k]])
        keys |= np.where(place >= k, b, 0).astype(np.uint64) << np.uint64(8 * k)
    return np.repeat(np.arange(len(spelled)), lengths), keys


class Letters:
    """Bits of spelled bytes, and the hashes of 1, 2, 3 and 5 bytes before."""

    SEEN = (1, 2, 3, 5)

    def __init__(self, keys: np.ndarray, seen: tuple[int, ...] = SEEN) -> None:
        self.byte = keys.astype(np.uint8)
        before = [(keys >> np.uint64(8 * k)).astype(np.uint8) for k in range(1, max(seen) + 1)]
        self.context = [_mix(*before[:k], k) for k in seen]

    def parts(self) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """First byte, slots by table, and eight bits a byte, some bytes at a time."""
        step = np.arange(8, dtype=np.uint32)
        for at in range(0, len(self.byte), LETTERS):
            byte = self.byte[at : at + LETTERS, None].astype(np.uint32)
            node = ((byte | 256) >> (8 - step)) * _M1
            bit = ((byte >> (7 - step)) & 1).astype(np.uint8).ravel()
            shift = np.uint32(32 - SPELL_BITS)
            slots = [(((c[at : at + LETTERS, None] ^ node) * _M2) >> shift).ravel().astype(np.intp) for c in self.context]
            yield at, slots, bit


class Counts:
    """Bit counts of all tables, in memory of fixed size: (slot, bit) pairs in a row.

    Tokens wait until there are many, then those that are equal to a table are counted together.
    """

    def __init__(self) -> None:
        sizes = [1 << (WORD_BITS + 1)] * WORD_TABLES + [1 << (SPELL_BITS + 1)] * SPELL_TABLES
        self._tables = [np.zeros(n, np.uint32) for n in sizes]
        self.spelled: set[bytes] = set()
        self.texts = self.waiting = 0
        self.keys: list[np.ndarray] = []

    @property
    def tables(self) -> list[np.ndarray]:
        self._count()
        return self._tables

    def add(self, texts: list[str], code: Code) -> None:
        self.texts += len(texts)
        self.code = code
        read = Texts(texts)
        symbols = code.symbols(read.hashes)
        self.keys.append(token_keys(symbols, read.starts, code.size))
        self.waiting += len(symbols)
        if self.waiting > TOGETHER:
            self._count()
        self.spelled.update(read.words(np.flatnonzero(symbols == 0)))
        if len(self.spelled) > 100_000:
            self.spell()

    def _count(self) -> None:
        if not self.waiting:
            return
        waiting = np.concatenate(self.keys)
        self.keys, self.waiting = [], 0
        for i, needed in enumerate((_OF_BEFORE, _OF_LAST)):
            keys, times = _distinct(waiting & needed)
            times = times.astype(np.uint32)
            for at in range(0, len(keys), TOKENS):
                part = keys[at : at + TOKENS]
                token, flat, bit = self.code.bits(key_symbols(part))
                slots = word_slots(contexts(part, self.code.size)[i], token, taken(self.code.hashed, flat))
                np.add.at(self._tables[i], slots * 2 + bit, taken(times[at : at + TOKENS], token))

    def spell(self) -> None:
        """Counts the bits of words without a symbol, each word once for every time the memory fills."""
        _, spelled = letter_keys(sorted(self.spelled))
        for table, k in zip(self._tables[WORD_TABLES:], Letters.SEEN, strict=True):
            keys, times = _distinct(spelled & np.uint64((1 << (8 * k + 8)) - 1))
            times = times.astype(np.uint32)
            for at, slots, bit in Letters(keys, (k,)).parts():
                np.add.at(table, slots[0] * 2 + bit, np.repeat(times[at : at + LETTERS], 8))
        self.spelled.clear()

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """What was counted, in compressed chunks."""
        self.spell()
        at = 0
        for table in self.tables:
            for chunk in table.reshape(-1, CHUNK):
                if chunk.any():
                    yield at, zlib.compress(chunk.astype("<u4").tobytes(), 1)
                at += 1


def _halved(sums: np.ndarray) -> np.ndarray:
    """Counts of both bits as 16-bit numbers in one; greater ones are scaled down together."""
    both = sums.reshape(-1, 2).astype(np.float64)
    most = both.max(axis=1, keepdims=True)
    both = np.where(most > 65_535, np.maximum(both * (65_535 / np.maximum(most, 1)), both > 0), both).astype(np.uint32)
    return both[:, 0] | (both[:, 1] << np.uint32(16))


class Model:
    """The code and the summed tables."""

    def __init__(self, code: Code, chunks: Iterable[tuple[int, bytes]]) -> None:
        self.code = code
        bits = [WORD_BITS] * WORD_TABLES + [SPELL_BITS] * SPELL_TABLES
        packed = np.zeros(sum(1 << b for b in bits), np.uint32)
        for at, raw in chunks:
            packed[at * CHUNK // 2 : (at + 1) * CHUNK // 2] = np.frombuffer(zlib.decompress(raw), "<u4")
        self.tables = np.split(packed, np.cumsum([1 << b for b in bits])[:-1])
        self.learnt: np.ndarray | None = None  # what the mixers have learnt, as numbers that add up


class Sent:
    """A model for tasks. Code and tables are broadcast once each: as a part of every function that uses them, each function
    would leave a copy of its own on the disks of the driver and all executors."""

    def __init__(self, code: Broadcast, tables: Broadcast, learnt: np.ndarray | None = None) -> None:
        self.code, self.tables, self.learnt = code, tables, learnt

    def model(self) -> Model:
        model = Model(self.code.value, [])
        model.tables, model.learnt = self.tables.value, self.learnt
        return model


class Scorer:
    """Scores texts, or learns from training texts in order; what it learns online stays in this object."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.of_words, self.of_letters = Mixer(16, [1.0, 0.2, 0.6]), Mixer(16, [1.0, 0.8, 0.7, 0.6])
        if model.learnt is not None and len(model.learnt):
            cut = len(self.of_words.sums())
            self.of_words.add(model.learnt[:cut])
            self.of_letters.add(model.learnt[cut:])

    def sums(self) -> np.ndarray:
        return np.concatenate([self.of_words.sums(), self.of_letters.sums()])

    @staticmethod
    def _seen(table: np.ndarray, slot: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        packed = taken(table, slot)
        zero, one = (packed & np.uint32(0xFFFF)).astype(np.float32), (packed >> np.uint32(16)).astype(np.float32)
        if own:  # the text's own bit was counted: predict without it
            zero -= own[0]
            one -= own[1]
            np.maximum(one, 0, out=one)
            np.maximum(zero, 0, out=zero)
        return zero, one

    def _letters(self, keys: np.ndarray, own: bool) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
        """First key, predictors, gate and bit of letter keys, some at a time."""
        for at, slots, bit in Letters(keys).parts():
            bits = bit.astype(np.float32)
            own_bits = (1 - bits, bits) if own else None
            prior, below, inputs, seen = np.float32(0.5), np.float32(0), [], []
            for table, slot in zip(self.model.tables[WORD_TABLES:], slots, strict=True):
                zero, one = self._seen(table, slot, own_bits)
                prior, odds = stretch(one, zero, prior, 0.6)
                inputs.append(odds - below)
                below = odds
                seen.append(zero + one)
            yield at, inputs, confidence(seen[2]) * np.uint8(4) + confidence(seen[3]), bits

    def _words(self, keys: np.ndarray, own: bool) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
        """First key, key index behind it, predictors, gate and bit of the code bits, ``TOKENS`` keys at a time."""
        code = self.model.code
        for at in range(0, len(keys), TOKENS):
            part = keys[at : at + TOKENS]
            token, flat, bit = code.bits(key_symbols(part))
            bits, node, p, odds = bit.astype(np.float32), *(taken(x, flat) for x in (code.hashed, code.p, code.odds))
            q = 1 - p
            own_bits = (1 - bits, bits) if own else None
            inputs, seen = [odds], []
            for table, context in zip(self.model.tables, contexts(part, code.size), strict=False):
                zero, one = self._seen(table, word_slots(context, token, node), own_bits)
                seen.append(zero + one)
                one += p
                zero += q
                inputs.append(ratio(one, zero))
                inputs[-1] -= odds
            yield at, token, inputs, confidence(seen[0]) * np.uint8(4) + confidence(seen[1]), bits

    def learn_words(self, read: Texts, symbols: np.ndarray) -> None:
        """Learn from every code bit of training texts, which are counted in the tables."""
        self.learn_tokens(token_keys(symbols, read.starts, self.model.code.size))

    def learn_tokens(self, keys: np.ndarray) -> None:
        """Learn from every code bit of tokens; equal tokens are worked out once and weigh as many."""
        keys, times = _shuffled(keys)
        for at, token, inputs, gate, bits in self._words(keys, True):
            self.of_words.learn(inputs, gate, bits, taken(times[at : at + TOKENS].astype(np.float32), token))

    def learn_letters(self, spelled: list[bytes]) -> None:
        """Learn from every bit of words that one training text has once."""
        keys, times = _shuffled(letter_keys(spelled)[1])
        for at, inputs, gate, bits in self._letters(keys, True):
            self.of_letters.learn(inputs, gate, bits, np.repeat(times[at : at + LETTERS].astype(np.float32), 8))

    def word_costs(self, keys: np.ndarray, own: bool) -> np.ndarray:
        """Nats of the code bits of each token; equal tokens are worked out once."""
        keys, which = np.unique(keys, return_inverse=True)
        costs = np.zeros(len(keys))
        for at, token, inputs, gate, bits in self._words(keys, own):
            cost = self.of_words.costs(inputs, gate, 2 * bits - 1)
            costs[at : at + TOKENS] = np.bincount(token, cost, len(keys[at : at + TOKENS]))
        return taken(costs, which)

    def letter_costs(self, spelled: list[bytes], own: bool) -> np.ndarray:
        """Nats of the bytes of each word; equal bytes behind equal ones are worked out once."""
        word, keys = letter_keys(spelled)
        keys, which = np.unique(keys, return_inverse=True)
        costs = np.zeros(len(keys))
        for at, inputs, gate, bits in self._letters(keys, own):
            costs[at : at + LETTERS] = self.of_letters.costs(inputs, gate, 2 * bits - 1).reshape(-1, 8).sum(axis=1)
        return np.bincount(word, taken(costs, which), len(spelled))

    def score(self, reads: list[Texts], counts: list[np.ndarray], own: bool) -> list[np.ndarray]:
        """Nats of each text; ``counts``: how often training texts have each token; ``own``: these are training texts,
        counted in the tables. Equal tokens of ``TOGETHER`` or more are worked out once."""
        code, out, at, held = self.model.code, [], 0, 0
        for end, read in enumerate(reads, 1):
            held += len(read.hashes)
            if held > TOGETHER or end == len(reads):
                out += self._score(reads[at:end], counts[at:end], own, code)
                at, held = end, 0
        return out

    def _score(self, reads: list[Texts], counts: list[np.ndarray], own: bool, code: Code) -> list[np.ndarray]:
        symbols = [code.symbols(read.hashes) for read in reads]
        costs = self.word_costs(np.concatenate([token_keys(s, read.starts, code.size) for s, read in zip(symbols, reads, strict=True)]), own)
        costs = np.split(costs, np.cumsum([len(s) for s in symbols])[:-1])
        spelled: dict[int, bytes] = {}
        places = []
        for read, symbol, count, cost in zip(reads, symbols, counts, costs, strict=True):
            escaped = np.flatnonzero(symbol == 0)
            others = count[escaped] - own
            old = others > 0
            cost[escaped[old]] -= np.log(others[old] / code.others * (1 - code.new))
            new = escaped[~old]
            places.append(new)
            hashes, where = np.unique(read.hashes[new], return_index=True)
            spelled.update(zip(hashes.tolist(), read.words(new[where]), strict=True))
        if spelled:
            hashes = np.array(list(spelled), np.uint64)
            nats, order = self.letter_costs(list(spelled.values()), own), np.argsort(hashes)
            for read, new, cost in zip(reads, places, costs, strict=True):
                cost[new] += nats[order[np.searchsorted(hashes, read.hashes[new], sorter=order)]] - np.log(code.new)
        return [np.add.reduceat(cost, read.starts) for read, cost in zip(reads, costs, strict=True)]


def _blocks(docs: DataFrame, key: Column, divisor: int, at: int) -> DataFrame:
    """``block, doc_id, held_out, text``: rows in the order they are read, cut into blocks of bounded size."""

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in small(batches):
            texts = batch.column(2)
            numbers = pa.array([block] * batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([numbers, *batch.columns], ["block", "doc_id", "held_out", "text"])
            filled += texts.nbytes
            if filled >= BLOCK:
                block, filled = block + 1, 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(key, divisor, at).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(number, f"block long, doc_id {kind}, held_out boolean, text string")


def _uses(blocks: DataFrame) -> DataFrame:
    """``block, word, n``: word hashes of each block and how often training texts of the block have them."""

    def use(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def ended() -> pa.RecordBatch:
            hashes, inverse = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([t for _, t in parts]), len(hashes)).astype(np.int64)
            columns = [pa.array(np.full(len(hashes), current)), pa.array(hashes.view(np.int64)), pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, ["block", "word", "n"])

        for batch in small(batches):
            numbers = batch.column(0).to_numpy()
            for block in np.unique(numbers).tolist():
                mine = batch.filter(pa.array(numbers == block))
                if parts and (block != current or sum(len(h) for h, _ in parts) > 3_000_000):
                    yield ended()
                    parts = []
                current = block
                read = Texts(mine.column(2).to_pylist())
                learnt = ~mine.column(1).to_numpy(zero_copy_only=False)
                parts.append((read.hashes, np.repeat(learnt, read.lengths)))
        if parts:
            yield ended()

    return blocks.select("block", "held_out", "text").mapInArrow(use, "block long, word long, n long")


def _code(counted: DataFrame) -> tuple[Code, int, int]:
    """The code, all training tokens, and how many are distinct; ``counted`` has one row per word: count."""
    step = F.floor(F.log2("count") * 16)
    steps = counted.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("count").alias("tokens")).collect()
    steps = sorted(steps, key=lambda r: -r["step"])
    tokens, distinct = sum(r["tokens"] for r in steps), sum(r["words"] for r in steps)
    taken, least = 0, None
    for r in steps:
        taken += r["words"]
        if taken > WORDS - 1:
            break
        least = r["step"]
    top = [] if least is None else counted.filter(step >= least).select("word", "count").collect()
    top = sorted(((r["count"], r["word"] % 2**64) for r in top), key=lambda r: (-r[0], r[1]))
    once = sum(r["words"] for r in steps if r["step"] == 0 and r["step"] != least)
    return Code([w for _, w in top], [n for n, _ in top], tokens - sum(n for n, _ in top), once), tokens, distinct


def _tables(blocks: DataFrame, code: Broadcast) -> list[tuple[int, bytes]]:
    """The bit counts of all training texts: summed per task, then by chunk, where one chunk is in memory at a time."""

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in small(batches, 256):
            counts.add(batch.column(0).to_pylist(), code.value)
        at, raw = zip(*counts.rows(), strict=True) if counts.texts else ((), ())
        for i in range(0, len(at), 64):
            columns = [pa.array(at[i : i + 64], pa.int64()), pa.array(raw[i : i + 64], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "raw"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, np.zeros(CHUNK, np.int64)

        def ended() -> pa.RecordBatch:
            raw = zlib.compress(_halved(sums).astype("<u4").tobytes(), 1)
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([raw], pa.binary())], ["chunk", "raw"])

        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk != current and current is not None:
                    yield ended()
                    sums[:] = 0
                current = chunk
                sums += np.frombuffer(zlib.decompress(raw.as_py()), "<u4")
        if current is not None:
            yield ended()

    layout = "chunk long, raw binary"
    parts = blocks.filter("NOT held_out").select("text").mapInArrow(tally, layout)
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = parts.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(add, layout)
    return [(r["chunk"], bytes(r["raw"])) for r in summed.collect()]


def _learnt(blocks: DataFrame, uses: DataFrame, sent: Sent) -> np.ndarray:
    """What the mixers learn from all training texts: a row of fixed size from each task, summed by place.

    The texts are read where they lie. The mixer of letters learns from new words only: those without a symbol that
    training texts have once.
    """

    def sums_of(scorer: Scorer) -> pa.Array:
        return pa.array([scorer.sums()], pa.list_(pa.float64()))

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, rare, keys = Scorer(sent.model()), {}, []

        def seen_once() -> pa.RecordBatch:
            got = {h: w for h, w in rare.items() if w is not None}
            rare.clear()
            hashes, spelled = np.array(list(got), np.uint64).view(np.int64), pa.array(got.values(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.nulls(len(got), pa.list_(pa.float64())), pa.array(hashes), spelled], ["sums", "word", "spelled"])

        for batch in small(batches):
            read = Texts(batch.column(0).to_pylist())
            symbols = scorer.model.code.symbols(read.hashes)
            keys.append(token_keys(symbols, read.starts, scorer.model.code.size))
            if sum(map(len, keys)) > TOGETHER:
                scorer.learn_tokens(np.concatenate(keys))
                keys = []
            escaped = np.flatnonzero(symbols == 0)
            hashes, where, n = np.unique(read.hashes[escaped], return_index=True, return_counts=True)
            for h, word, times in zip(hashes.tolist(), read.words(escaped[where]), n.tolist(), strict=True):
                rare[h] = None if times > 1 or h in rare else word
            if len(rare) > 300_000:
                yield seen_once()
        yield seen_once()
        if keys:
            scorer.learn_tokens(np.concatenate(keys))
        last = [sums_of(scorer), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())]
        yield pa.RecordBatch.from_arrays(last, ["sums", "word", "spelled"])

    def letters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, spelled = Scorer(sent.model()), []
        for batch in batches:
            spelled += batch.column(0).to_pylist()
            if len(spelled) > 100_000:
                scorer.learn_letters(spelled)
                spelled = []
        scorer.learn_letters(spelled)
        yield pa.RecordBatch.from_arrays([sums_of(scorer)], ["sums"])

    rows = blocks.filter("NOT held_out").select("text").mapInArrow(words, "sums array<double>, word long, spelled binary")
    rows = written(rows, "score-learnt", compression="zstd")
    once = uses.filter("first AND count = 1").select("word")
    new = rows.filter("word IS NOT NULL").join(once, "word", "left_semi").select("spelled")
    sums = rows.filter("sums IS NOT NULL").select("sums").unionAll(new.mapInArrow(letters, "sums array<double>"))
    total = sums.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(total, key=lambda r: r["at"])])


def _packed(blocks: DataFrame) -> DataFrame:
    """``block, raw``: some rows of a block each, compressed together: the texts are the most that is shuffled."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in small(batches, 512):
            numbers, raw = batch.column(0).to_numpy(), []
            found = np.unique(numbers)
            for block in found:
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema, options=options) as stream:
                    stream.write_batch(batch.filter(pa.array(numbers == block)))
                raw.append(out.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(raw, pa.binary())], ["block", "raw"])

    return blocks.select("block", "doc_id", "held_out", "text").mapInArrow(pack, "block long, raw binary")


def _score_block(sent: Sent, tokens: int, distinct: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

    def score(docs: pa.Table, uses: pa.Table) -> pa.Table:
        order = np.argsort(uses.column("word").to_numpy().view(np.uint64))
        keys = uses.column("word").to_numpy().view(np.uint64)[order]
        counts = uses.column("count").to_numpy()[order]
        docs = pa.concat_tables([pa.ipc.open_stream(raw.as_buffer()).read_all() for raw in docs.column("raw")])
        docs = docs.select(["doc_id", "held_out", "text"])
        docs = docs.take(pa.compute.sort_indices(docs, [("doc_id", "ascending"), ("text", "ascending")]))
        scorer, parts = Scorer(sent.model()), []
        out = docs.column("held_out").to_numpy()
        for own in (True, False):
            mine = docs.filter(pa.array(out != own))
            slices = [mine.slice(at, 128) for at in range(0, mine.num_rows, 128)]
            reads = [Texts(part.column("text").to_pylist()) for part in slices]
            found = [counts[np.searchsorted(keys, read.hashes)] for read in reads]
            for part, read, count, nats in zip(slices, reads, found, scorer.score(reads, found, own), strict=True):
                base = np.log10((count + 1) / (tokens + distinct + 1))
                sums = [np.add.reduceat(x, read.starts) for x in (count > 0, base)]
                values = [read.lengths, sums[0].astype(np.int64), np.full(part.num_rows, tokens), sums[1], -nats / np.log(10), nats / np.log(2) / read.bytes()]
                parts.append(pa.Table.from_arrays([part.column("doc_id"), part.column("held_out"), *map(pa.array, values)], names))
        return pa.concat_tables(parts)

    return score


def language_model_scores(docs: DataFrame, divisor: int = 7, at: int = 2) -> DataFrame:
    """One row per ``doc_id, text`` row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, and
    ``bits_per_byte`` of the mixed model over the words and one byte behind each.

    Counts, tables, the code and the mixer come from all rows that are not held out (crc32 of doc_id modulo ``divisor`` is ``at``).
    ``score`` is log10 of the model's probability. Null and empty texts are the end alone. Repeated rows are scored each,
    by the same mixer. Without training texts the base score
    is zero and the model knows nothing but its code. An empty table gives no rows.
    """
    blocks = written(_blocks(docs, F.col("doc_id"), divisor, at), "score-blocks", compression="zstd")
    by_word = Window.partitionBy("word")
    uses = _uses(blocks).withColumn("count", F.sum("n").over(by_word))
    uses = uses.withColumn("first", F.row_number().over(by_word.orderBy("block", "n")) == 1)
    uses = written(uses.select("block", "word", "count", "first"), "score-words", compression="zstd")
    code, tokens, distinct = _code(uses.filter("first AND count > 0"))
    broadcast = docs.sparkSession.sparkContext.broadcast
    sent_code = broadcast(code)
    sent = Sent(sent_code, broadcast(Model(code, _tables(blocks, sent_code)).tables))
    sent = Sent(sent.code, sent.tables, _learnt(blocks, uses, sent))
    grouped = _packed(blocks).groupBy("block").cogroup(uses.select("block", "word", "count").groupBy("block"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return grouped.applyInArrow(_score_block(sent, tokens, distinct), layout)
