"""Minimal acyclic transducers: sorted words to their ranks.

Words come in byte order, so a state is final as soon as a word leaves it, and equal states are merged at once: the
automaton is minimal at every step and the unmerged part is one word long. A transition carries the number of words that
come before those behind it; the sum along a word's path is the word's rank among all words of the transducer.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterable

import numpy as np

_HEAD = struct.Struct("<III")


def build(words: Iterable[bytes]) -> bytes:
    """The transducer of distinct words in byte order: states below their parents, transitions in order."""
    states: list[tuple[bool, tuple]] = []
    register: dict[tuple[bool, tuple], int] = {}
    path: list[list] = [[False, []]]  # of the last word: is it an end, transitions that are settled
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            end, arcs = path.pop()
            state = end, tuple(arcs)
            if state not in register:
                register[state] = len(states)
                states.append(state)
            path[-1][1].append((last[len(path) - 1], register[state]))

    for word in words:
        shared = 0
        for x, y in zip(last, word, strict=False):
            if x != y:
                break
            shared += 1
        settle(shared)
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        last = word
    settle(0)
    states.append((path[0][0], tuple(path[0][1])))
    counts: list[int] = []
    keys, targets, before = [], [], []
    for number, (end, arcs) in enumerate(states):
        passed = int(end)
        for byte, target in arcs:
            keys.append(number << 8 | byte)
            targets.append(target)
            before.append(passed)
            passed += counts[target]
        counts.append(passed)
    ends = np.packbits([end for end, _ in states])
    return _HEAD.pack(len(states), len(keys), counts[-1]) + b"".join(np.array(x, "<u4").tobytes() for x in (keys, targets, before)) + ends.tobytes()


class Transducer:
    """A built transducer; the root is the last state."""

    def __init__(self, raw: bytes) -> None:
        self.states, arcs, self.words = _HEAD.unpack_from(raw)
        body = np.frombuffer(raw, "<u4", 3 * arcs, _HEAD.size)
        self.keys, self.targets, self.before = body[:arcs].astype(np.int64), body[arcs : 2 * arcs].astype(np.int64), body[2 * arcs :].astype(np.int64)
        self.ends = np.unpackbits(np.frombuffer(raw, np.uint8, offset=_HEAD.size + 12 * arcs), count=self.states).astype(bool)

    def after(self, prefix: bytes) -> tuple[int, int] | None:
        """The state behind a prefix and the number of words before those that have it; None if no word has it."""
        state, rank = self.states - 1, 0
        for byte in prefix:
            at = int(np.searchsorted(self.keys, state << 8 | byte))
            if at == len(self.keys) or self.keys[at] != state << 8 | byte:
                return None
            state, rank = int(self.targets[at]), rank + int(self.before[at])
        return state, rank

    def ranks(self, words: list[bytes], prefix: bytes = b"") -> np.ndarray:
        """The rank of each word behind ``prefix``, -1 for none: all words take their first byte, then their second, …"""
        out = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        begin = self.after(prefix)
        if begin is None:
            return out
        going, state, rank, depth = np.arange(len(words)), np.full(len(words), begin[0]), np.full(len(words), begin[1]), 0
        while len(going):
            over = lengths[going] == depth
            done = over & self.ends[state]
            out[going[done]] = rank[done]
            going, state, rank = going[~over], state[~over], rank[~over]
            wanted = state << 8 | text[starts[going] + depth]
            at = np.searchsorted(self.keys, wanted)
            hit = at < len(self.keys)
            hit[hit] = self.keys[at[hit]] == wanted[hit]
            going, state, rank, depth = going[hit], self.targets[at[hit]], rank[hit] + self.before[at[hit]], depth + 1
        return out

    def word(self, rank: int) -> bytes:
        """The word of a rank."""
        state, out = self.states - 1, bytearray()
        while rank or not self.ends[state]:
            lo, hi = np.searchsorted(self.keys, [state << 8, (state + 1) << 8]).tolist()
            at = lo + bisect_right(self.before[lo:hi].tolist(), rank) - 1
            out.append(int(self.keys[at]) & 255)
            rank -= int(self.before[at])
            state = int(self.targets[at])
        return bytes(out)
