"""Token ids of words by a public vocabulary, remembered per task."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

# Ways of splitting under which white space ends every token, whatever stands around it: the words of a text can then be
# encoded each on its own. Fixed values of the vocabulary file's format.
WORDWISE_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
WORDWISE_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
MARKS = b".,;:!?"


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_wordwise(file: str) -> bool:
    """Whether the vocabulary at ``file`` drops white space and never looks across it."""
    if not file.endswith(".json"):
        return False
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (
        tuple((spec.get("normalizer") or {}).get("normalizers", ())) == WORDWISE_NORMALIZERS
        and split.get("pattern") == {"Regex": WORDWISE_PATTERN}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest] == [("ByteLevel", False, False)]
        and spec["model"].get("end_of_word_suffix") == "</w>"
        and not any(t["lstrip"] or t["rstrip"] or set(t["content"]) & set(" \t\n\x0b\f\r") for t in spec["added_tokens"])
    )


@lru_cache(maxsize=2)
def library(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def word_ids(file: str) -> WordIds:
    """One memory per worker process: tasks that follow each other in it share the words."""
    return WordIds(file)


class WordIds:
    """Ids of white-space-separated words as little-endian 32-bit bytes; the library encodes each new word once.

    For vocabularies of ``is_wordwise``. Words are remembered in two generations of at most ``limit`` words, so the memory
    does not grow with the input and frequent words stay. Special strings are the library's: they hold no white space, so
    they lie within one word, and texts with ``<`` keep their capitals, because the library looks for those strings
    before it lower-cases.
    """

    def __init__(self, file: str, limit: int = 250_000) -> None:
        self.tokenizer = library(file)
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.fromiter(((self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)), bool, size)

    @staticmethod
    def words(text: str) -> list[bytes]:
        raw = text.encode()
        return raw.split() if b"<" in raw else raw.lower().split()

    def ids(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the ids of its words."""
        split = [self.words(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.limit:
                self.old, self.known = self.known, {}
                new = set().union(*split)
            old = self.old
            back = [w for w in new if w in old]
            self.known.update((w, old[w]) for w in back)
            self._learn(new.difference(back))
        find = self.known.__getitem__
        return [list(map(find, words)) for words in split]

    def _learn(self, new: set[bytes]) -> None:
        known, plain, ending, rest = self.known, set(), [], []
        for w in new:
            stem = w[:-1] if w[-1] in MARKS else w
            if stem.decode(errors="replace").isalpha():
                if stem not in known:
                    plain.add(stem)
                if stem is not w:
                    ending.append(w)
            else:
                rest.append(w)
        rest += [m for w in ending if (m := w[-1:]) not in known]
        plain_list = sorted(plain)
        parts = [plain_list[i : i + 1000] for i in range(0, len(plain_list), 1000)]
        for part, got in zip(parts, self._encode([b" ".join(p) for p in parts]), strict=True):
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) == len(part):  # one end per word: every word is one run of letters
                raw, at = got.tobytes(), 0
                for w, cut in zip(part, (cuts * 4).tolist(), strict=True):
                    known[w] = raw[at:cut]
                    at = cut
            else:
                rest += part
        rest = list(dict.fromkeys(rest))
        for w, got in zip(rest, self._encode(rest), strict=True):
            known[w] = got.tobytes()
        for w in ending:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(c.ids, "<u4") for c in coded]
