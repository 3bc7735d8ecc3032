"""Bytes as the samples of a grey image of 64 columns, in a PNG file, and back."""

from __future__ import annotations

import struct
import zlib

import numpy as np

COLUMNS = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(raw: bytes) -> bytes:
    """``raw`` with zero bytes appended up to a positive multiple of the image's width."""
    return raw + bytes(-len(raw) % COLUMNS or (0 if raw else COLUMNS))


def encode(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, COLUMNS)
    lines = np.zeros((len(rows), COLUMNS + 1), np.uint8)  # every line starts with its filter, 0: none
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", COLUMNS, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(file: bytes) -> bytes:
    """Samples of a file made by ``encode``; any damage, and any other kind of image, raises ValueError."""
    if file[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, header, body = 8, b"", []
    while at < len(file):
        (size,) = struct.unpack_from(">I", file, at)
        kind, part = file[at + 4 : at + 8], file[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + part)) != file[at + 8 + size : at + 12 + size]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            header = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    columns, rows, *form = struct.unpack(">IIBBBBB", header)
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if form != [8, 0, 0, 0, 0] or columns != COLUMNS or len(lines) != rows * (COLUMNS + 1):
        raise ValueError("not an 8-bit grey image of 64 columns")
    lines = lines.reshape(rows, COLUMNS + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not written here")
    return lines[:, 1:].tobytes()
