"""Plain Python versions of what the operators compute, and small documents to try them on."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1
# columns that operators use themselves: a table may have its own of those names
CLASHING = ["doc", "text_hash", "n", "key", "node", "size", "length", "block", "word", "hash", "lines", "salt", "weight"]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower_words(text: str | None) -> list[str]:
    return words((text or "").translate(LOWER))


def invented(seed: int, n: int = 60, stems: str = "an er th in on re at en nd ti es or") -> str:
    r = random.Random(seed)
    parts = stems.split()
    out = ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 11 == 10 else w for i, w in enumerate(out))


def near(text: str, seed: int, changes: int) -> str:
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), changes):
        w[i] = "changed" + str(seed)
    return " ".join(w)


def rows() -> list[tuple]:
    """doc_id, text, lang, source: nulls, empty and very long texts, copies, near copies, repeated rows, ties."""
    base = [(i, invented(i), "en" if i % 2 else None, f"s{i % 3}") for i in range(30)]
    base += [(100 + i, base[3][1], "en", "s0") for i in range(4)]
    base += [(200 + i, near(base[5][1], i, 1), "en", "s1") for i in range(6)]
    base += [(300, None, None, None), (301, "", "en", "s2"), (302, " \t\n\x0b\r\n ", None, "s0"), (None, "no id but words", None, "s1")]
    base += [(310, "one two", "en", None), (311, "one two", "en", None), (312, "ONE two", "en", "s1")]
    base += [(320, "\n".join(["Shared Line here", " shared line HERE\t", "own line %d" % k]), "en", "s2") for k in (1,)]
    base += [(321, "shared line here\nshort\nshort\nshared line here", "en", "s2"), (322, "short\n\nshort", "en", "s2")]
    base += [(330, invented(99, 9000), "en", "s1"), (331, "x" * 5000, None, "s1"), (332, "#*$ " * 40, "en", "s2")]
    base += [(333, "éé çà —   “x” <|endoftext|> it's 12 ퟿ \U0001f600", "fr", "s2")]
    base += [base[0], base[0], base[7]]
    return base


def documents(spark: SparkSession, clash: bool = True) -> DataFrame:
    extra = CLASHING if clash else []
    layout = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
    data = [(*r, len(r[1] or ""), *["x"] * len(extra)) for r in rows()]
    return spark.createDataFrame(data, layout).repartition(5)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def keyed(found: list, *names: str) -> Counter:
    return Counter(tuple(r[n] for n in names) for r in found)


def crc(doc_id: int | None, divisor: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % divisor


def kept_lines(data: list[tuple]) -> list[tuple]:
    """doc_id, text, lines, dropped lines, kept text."""
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    owners: dict[str, set] = {}
    for k, text, *_ in data:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owners.setdefault(key(line), set()).add(LAST if k is None else k)
    out = []
    for k, text, *_ in data:
        lines = (text or "").split("\n")
        me = LAST if k is None else k
        left = [x for x in lines if len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == me]
        out.append((k, text, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def shingles(text: str | None) -> frozenset:
    w = lower_words(text)
    width = min(5, len(w))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if w else frozenset()


def near_components(data: list[tuple]) -> list[tuple]:
    """doc_id, shingles, component, kept."""
    sets = [(LAST if r[0] is None else r[0], shingles(r[1])) for r in data]
    parent = {k: k for k, _ in sets}

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                u, v = sorted((root(a), root(b)))
                parent[v] = u
    hide = lambda k: None if k == LAST else k
    return [(hide(k), len(s), hide(root(k)), root(k) == k) for k, s in sets]


def mixture(data: list[tuple]) -> list[tuple]:
    """doc_id, size, source_size, target, taken."""
    sized = [(r[0], len(words(r[1])), r[3], int(hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()[:9], 16)) for r in data]
    total = Counter()
    for _, size, source, _ in sized:
        total[source] += size
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        full = {s for s in free if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 3 * total[s] for s in full}
        left -= sum(3 * total[s] for s in full)
        free -= full
    out = []
    for source in order:
        mine = sorted((r for r in sized if r[2] == source), key=lambda r: r[3])
        whole = int(target[source] // total[source]) if total[source] else 0
        rest, through, limit = target[source] - whole * total[source], 0, 2**36
        for h in sorted({r[3] for r in mine}):
            here = sum(r[1] for r in mine if r[3] == h)
            if through + here > rest:
                limit = h + (through + here - rest < rest - through)
                break
            through += here
        for k, size, _, h in mine:
            copies = whole + (h < limit and whole < 3) if total[source] else 0
            out.append((k, size, total[source], target[source], size * copies))
    return out
