"""Token counts of texts of any length by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets. Two neighbours are spliced where both start a token at the same
white-space edge: the left chunk is right up to there, and splitting by pattern goes on from a position without looking
back, so the right chunk is right from there. Where an overlap holds no such edge, it is widened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import SPACES, small
from tickloom.llm.vocabulary import is_wordwise, library, path, word_ids

CHUNK, OVERLAP = 16_384, 256
Starts = Callable[[list[str]], list[np.ndarray]]


def starts_of(file: str) -> Starts:
    """Gives the character offsets at which the tokens of texts start, in order."""
    if file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)

        def pieces(texts: list[str]) -> list[np.ndarray]:
            out = []
            for text in texts:
                found = model.encode(text, return_type="proto", num_threads=1).pieces
                at = np.array([p.begin for p in found], np.int64)
                if not text.isascii():  # offsets are in bytes
                    raw = np.frombuffer(text.encode(), np.uint8)
                    at = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))[at]
                out.append(at)
            return out

        return pieces

    tokenizer = library(file)

    def offsets(texts: list[str]) -> list[np.ndarray]:
        coded = tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array([a for a, _ in c.offsets], np.int64) for c in coded]

    return offsets


def splice(text: str, left: np.ndarray, right: np.ndarray, begin: int, end: int) -> int | None:
    """A position in ``[begin, end)`` where tokens start in both neighbours and white space stops or begins.

    ``left`` and ``right`` are starts in the whole text. The first token of ``right`` may be the tail of a longer one.
    """
    common = np.intersect1d(left[left > begin], right)
    for p in common[common < end].tolist():
        if (text[p - 1] in SPACES) != (text[p] in SPACES):
            return p
    return None


def count_tokens(text: str, starts: Starts, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, equal to encoding it whole; memory is that of a few chunks, unless it has no white space."""
    if len(text) <= chunk:
        return len(starts([text])[0])
    step = chunk - overlap
    begins = list(range(0, len(text) - overlap, step))
    total, since = 0, 0
    begin, end = 0, min(chunk, len(text))
    left = starts([text[begin:end]])[0] + begin
    for at in begins[1:]:
        stop = min(at + chunk, len(text))
        if stop <= end:
            continue
        right = starts([text[at:stop]])[0] + at
        wider = overlap
        while (p := splice(text, left, right, max(at, since), end)) is None and end < stop:
            wider *= 2
            end = min(end + wider, stop)
            left = starts([text[begin:end]])[0] + begin
        if p is None:  # the left chunk has grown over the whole of the right one
            continue
        total += int(np.count_nonzero((left >= since) & (left < p)))
        since, begin, end, left = p, at, stop, right
    return total + int(np.count_nonzero(left >= since))


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, huge: int = 2 * CHUNK) -> DataFrame:
    """One row per ``doc_id, text`` row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are the library's (tokenizers for .json, sentencepiece for .model) without added tokens. A null text counts as
    empty: no bytes, no tokens. Repeated rows are counted each; an empty table gives no rows. Texts over ``huge``
    characters go through overlapping chunks; words of shorter ones are remembered where white space ends every token.
    """
    file = path(vocabulary)
    wordwise = is_wordwise(file)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = starts_of(file)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            if wordwise:
                short = word_ids(file).ids([t if len(t) <= huge else "" for t in texts])
                counts = [sum(map(len, ids)) // 4 for ids in short]
            else:
                counts = [len(s) for s in starts([t if len(t) <= huge else "" for t in texts])]
            for i, text in enumerate(texts):
                if len(text) > huge:
                    counts[i] = count_tokens(text, starts)
            over = pa.array([c > limit for c in counts], pa.bool_())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), over]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
