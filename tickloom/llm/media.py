"""Interleaved document sequences: HTML pages as ordered text and media references, resolved by digest.

A page becomes one array of items in reading order. An item is a run of text or a reference to a medium with its caption;
its position never changes, so text, media and captions stay aligned however references are resolved. Media are stored
once per task and digest, outside the sequences; a join on the digest brings in what is known about them.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import png
from tickloom.session import written

ITEM = "struct<position: int, kind: string, text: string, digest: string, n_bytes: bigint, caption: string>"
SCHEME = "sha256:"
# Fixed values of the HTML standard: elements that end a run of text, media elements, and what is not shown.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
MEDIA = frozenset("audio embed img source video".split())
HIDDEN = frozenset("script style template noscript".split())


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figures: list[list[dict]] = []  # media of the figures that are open
        self.in_caption = False

    def _add(self, kind: str, text: str | None = None, digest: str | None = None, n_bytes: int | None = None, caption: str | None = None) -> dict:
        item = {"position": len(self.items), "kind": kind, "text": text, "digest": digest, "n_bytes": n_bytes, "caption": caption}
        self.items.append(item)
        return item

    def _end_run(self) -> None:
        text = "".join(self.run).strip()
        self.run.clear()
        if not text:
            return
        if self.in_caption and self.figures:
            for item in self.figures[-1]:
                item["caption"] = text
        else:
            self._add("text", text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS or tag in MEDIA:
            self._end_run()
        if tag == "figure":
            self.figures.append([])
        elif tag == "figcaption":
            self.in_caption = True
        elif tag in MEDIA:
            named = dict(attrs)
            source, size = named.get("src") or "", named.get("data-bytes") or ""
            if source:
                known = source[len(SCHEME) :] if source.startswith(SCHEME) else hashlib.sha256(source.encode()).hexdigest()
                item = self._add("media", None, known, int(size) if size.isdecimal() else None, named.get("alt") or None)
                if self.figures:
                    self.figures[-1].append(item)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS:
            self._end_run()
        if tag == "figcaption":
            self.in_caption = False
        elif tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.run.append(data)


def items(page: str | None) -> list[dict]:
    """Items of a page in reading order; a null or empty page has none. A ``src`` of the form sha256:HEX names a digest,
    any other address is known by the digest of its text. Media of a figure get its caption, others their alt text."""
    parser = _Items()
    parser.feed(page or "")
    parser.close()
    parser._end_run()
    return parser.items


def sequences(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """``key, items`` for every row of ``pages``; other columns are ignored."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parsed = pa.array([items(t.as_py()) for t in part.column(1)], ITEMS)
                yield pa.RecordBatch.from_arrays([part.column(0), parsed], [key, "items"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, column).mapInArrow(parse, f"`{key}` {kind}, items array<{ITEM}>")


ITEMS = pa.list_(
    pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("caption", pa.string())])
)


def references(found: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per media reference: ``key, position, digest, n_bytes, caption``; sequences without media have none."""
    media = F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item")
    return found.select(key, media).select(key, "item.position", "item.digest", "item.n_bytes", "item.caption")


def resolve(found: DataFrame, known: DataFrame, key: str = "page_id") -> DataFrame:
    """Media references with the columns of ``known`` (one row per digest); those of unknown media are null."""
    named = known.withColumnRenamed("digest", "known_digest")
    refs = references(found, key)
    return refs.join(named, refs["digest"] == named["known_digest"], "left").drop("known_digest")


def feature(samples: bytes) -> str:
    """Rows, mean, deviation and entropy of the samples, as text with fixed decimals."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256).astype(float)
    p, values = counts / counts.sum(), np.arange(256)
    mean = float((p * values).sum())
    spread = float((p * (values - mean) ** 2).sum()) ** 0.5
    entropy = -float((p[p > 0] * np.log2(p[p > 0])).sum())
    return f"rows={len(samples) // png.COLUMNS};mean={mean:.3f};dev={spread:.3f};bits={entropy:.4f}"


FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def facts(stored: DataFrame) -> DataFrame:
    """What the stored files ``digest, media`` hold, read back: one row per digest."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, file in zip(batch.column(0), batch.column(1), strict=True):
                raw = file.as_py()
                samples = png.decode(raw)
                kept = hashlib.sha256(samples).hexdigest()
                if kept != digest.as_py():
                    raise ValueError(f"the medium {digest} holds other bytes")
                rows.append((kept, len(samples), kept, zlib.crc32(samples[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            names = [x.split()[0] for x in FACTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    rows = stored.select("digest", "media").mapInArrow(read, FACTS)
    return rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in rows.columns[1:]))


def page_of(text: str, digest: str, size: int) -> str:
    """A text as a page: a paragraph per line, and the medium that holds it behind."""
    lines = "".join(f"<p>{html.escape(line, quote=False)}</p>" for line in text.split("\n"))
    return f'<article>{lines}</article><figure><img src="{SCHEME}{digest}" data-bytes="{size}"><figcaption>{size} bytes of text</figcaption></figure>'


def document_pages(docs: DataFrame) -> DataFrame:
    """Every document as ``doc_id, html`` whose figure refers to the document's bytes as a medium."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, pages = batch.slice(at, 256), []
                for text in part.column(1):
                    text = text.as_py() or ""
                    raw = text.encode()
                    pages.append(page_of(text, hashlib.sha256(png.padded(raw)).hexdigest(), len(raw)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages, pa.string())], ["doc_id", "html"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, html string")


def document_media(docs: DataFrame) -> DataFrame:
    """``digest, media``: the bytes of texts as PNG files, equal ones once per task's batch."""

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[str] = set()
            for at in range(0, batch.num_rows, 256):
                names, files = [], []
                for text in batch.column(0).slice(at, 256):
                    samples = png.padded((text.as_py() or "").encode())
                    digest = hashlib.sha256(samples).hexdigest()
                    if digest not in seen:
                        seen.add(digest)
                        names.append(digest)
                        files.append(png.encode(samples))
                columns = [pa.array(names, pa.string()), pa.array(files, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "media"])

    return docs.select("text").mapInArrow(store, "digest string, media binary")


def document_sequences(docs: DataFrame) -> DataFrame:
    """One row per ``doc_id, text`` row: its medium stored, resolved by digest and read back.

    Columns: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position,
    caption``. A null text counts as empty: 64 zero bytes. Texts that differ in zero bytes at the end share a medium but
    not n_bytes. Repeated rows are resolved each; an empty table gives no rows.
    """
    known = facts(written(document_media(docs), "media"))
    found = resolve(sequences(document_pages(docs), "doc_id"), known, "doc_id")
    order = ["doc_id", "n_bytes", *(x.split()[0] for x in FACTS.split(", ")[1:]), "position", "caption"]
    return found.select(*order)
