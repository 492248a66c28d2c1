"""Media columns: byte payloads as PNG images, read back and fingerprinted.

A payload is laid out as scanlines of 64 RGB pixels (192 bytes of 8-bit
samples). The writer picks one of the filters None, Sub and Up for each
scanline and compresses with zlib; the reader tests the signature and every
chunk's CRC, inflates, undoes all five filters with numpy and gives the bytes
back. The fingerprint is the sign pattern of the image's low-frequency cosine
terms.

Defined results: null and empty texts are one scanline of spaces; equal texts
give equal rows; every other column, nulls and clashing names included, is left
out of the result except the id, which may be null or repeated.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._kernel import slices

WIDTH, CHANNELS = 64, 3
LINE = WIDTH * CHANNELS
#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HASH_SIDE, GRID = 8, 32


class MediaError(ValueError):
    """The stored form is damaged."""


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of a scanline."""
    return data + b" " * (-len(data) % LINE if data else LINE)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """payload, a positive multiple of 192 bytes, as an RGB image 64 pixels wide."""
    if not payload or len(payload) % LINE:
        raise MediaError("a payload must be whole scanlines")
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, LINE)
    sub, up = rows.copy(), rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up[1:] -= rows[:-1]
    tried = np.stack([rows, sub, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    pick = cost.argmin(axis=0)
    lines = np.empty((len(rows), LINE + 1), dtype=np.uint8)
    lines[:, 0] = pick
    lines[:, 1:] = tried[pick, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at = 8
    while at < len(media):
        if at + 12 > len(media):
            raise MediaError("a chunk is cut off")
        size = int.from_bytes(media[at : at + 4], "big")
        kind, body, crc = media[at + 4 : at + 8], media[at + 8 : at + 8 + size], media[at + 8 + size : at + 12 + size]
        if len(body) < size or int.from_bytes(crc, "big") != zlib.crc32(media[at + 4 : at + 8 + size]):
            raise MediaError(f"checksum of {kind!r} is wrong")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise MediaError("no end chunk")


def _paeth_line(line: np.ndarray, above: np.ndarray, step: int) -> None:
    left = np.zeros(step, np.int16)
    corner = np.zeros(step, np.int16)
    for x in range(0, len(line), step):
        up = above[x : x + step].astype(np.int16)
        base = left + up - corner
        da, db, dc = abs(base - left), abs(base - up), abs(base - corner)
        guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        line[x : x + step] += guess.astype(np.uint8)
        left, corner = line[x : x + step].astype(np.int16), up


def _average_line(line: np.ndarray, above: np.ndarray, step: int) -> None:
    left = np.zeros(step, np.int16)
    for x in range(0, len(line), step):
        line[x : x + step] += ((left + above[x : x + step]) // 2).astype(np.uint8)
        left = line[x : x + step].astype(np.int16)


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Scanlines (filter byte first) back to samples."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise MediaError("unknown filter")
    sub = kinds == 1
    if sub.any():  # a running sum along the line for each channel
        own = rows[sub].reshape(int(sub.sum()), -1, step)
        rows[sub] = np.cumsum(own, axis=1, dtype=np.uint8).reshape(len(own), -1)
    for y in np.flatnonzero(kinds >= 2):
        above = rows[y - 1] if y else np.zeros_like(rows[0])
        if kinds[y] == 2:
            rows[y] += above
        elif kinds[y] == 3:
            _average_line(rows[y], above.astype(np.int16), step)
        else:
            _paeth_line(rows[y], above, step)
    return rows


def decode_png(media: bytes) -> np.ndarray:
    """The samples, height x (width * channels), of an 8-bit image without interlace."""
    shape, packed = None, []
    for kind, body in _chunks(media):
        if kind == b"IHDR":
            wide, high, depth, color, *rest = struct.unpack(">IIBBBBB", body)
            step = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
            if depth != 8 or step is None or any(rest):
                raise MediaError("only 8-bit images without palette and interlace are read")
            shape = high, wide * step, step
        elif kind == b"IDAT":
            packed.append(body)
    if shape is None:
        raise MediaError("no header")
    high, line, step = shape
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != high * (line + 1):
        raise MediaError("the image is cut off")
    return unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(high, line + 1), step)


_COS = np.cos(np.pi * (2 * np.arange(GRID) + 1) * np.arange(HASH_SIDE)[:, None] / (2 * GRID))


def cosine_hash(rows: np.ndarray, channels: int = CHANNELS) -> str:
    """16 hex digits: which of the 64 lowest cosine terms are over their median."""
    gray = rows.reshape(len(rows), -1, channels).mean(axis=2)
    for axis in (0, 1):  # cell means down to GRID, or repeats up to it
        size = gray.shape[axis]
        edge = np.arange(GRID + 1) * size // GRID
        if size >= GRID:
            gray = np.add.reduceat(gray, edge[:-1], axis=axis) / np.diff(edge).reshape([-1, 1] if axis == 0 else [1, -1])
        else:
            gray = np.take(gray, np.arange(GRID) * size // GRID, axis=axis)
    low = (_COS @ gray @ _COS.T).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        out: dict[str, list] = {"media": [], "n_bytes": [], "payload": [], "feature": []}
        for text in batch.column("text"):
            data = (text.as_py() or "").encode()
            media = encode_png(pad(data))
            rows = decode_png(media)
            out["media"].append(media)
            out["n_bytes"].append(len(data))
            out["payload"].append(rows.tobytes())
            out["feature"].append(cosine_hash(rows))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["media"], pa.binary()), pa.array(out["payload"], pa.binary()), pa.array(out["feature"], pa.string())],
            names=["doc_id", "n_bytes", "media", "payload", "feature"],
        )


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the PNG), payload (bytes read back from it), feature. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        _columns, f"doc_id {kind}, n_bytes long, media binary, payload binary, feature string"
    )


def digest(payload: bytes) -> tuple[int, str, int]:
    """Length, SHA-256 and the CRC-32 of the last 16 bytes."""
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])
