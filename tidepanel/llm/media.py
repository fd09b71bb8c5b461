"""Operator 5: texts stored losslessly as PNG images in a binary column, read back and hashed.

``encode`` puts the UTF-8 bytes of a text, padded with spaces to a positive multiple of 192, into an
image 64 pixels wide with three 8-bit samples a pixel. ``decode`` walks the chunks of each image,
tests every checksum, inflates, undoes the row filters with numpy and computes a 64-bit hash of the
low frequencies of the cosine transform. Neither step shuffles; memory is bounded by one chunk of
texts (``chunks.CHUNK_BYTES``) or one longer text.

Nulls: a null text is stored as the empty text; a null doc_id is kept. Repeated rows are stored
each. An empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chunks import chunks

WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit RGB image of ``payload``; each row gets the filter (none, left, up) of the least sum of differences."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    left = rows.copy()
    left[:, SAMPLES:] -= rows[:, :-SAMPLES]
    up = rows.copy()
    up[1:] -= rows[:-1]
    forms = np.stack([rows, left, up])
    kinds = np.abs(forms.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    body = np.empty((len(rows), ROW + 1), np.uint8)
    body[:, 0] = kinds
    body[:, 1:] = forms[kinds, np.arange(len(rows))]
    packed = zlib.compress(body.tobytes(), 1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    data = [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *data, _chunk(b"IEND", b"")])


def _unfilter(body: np.ndarray, pixel: int) -> np.ndarray:
    """Rows without their filters; rows of one filter in a row are undone together where numpy can."""
    kinds, rows = body[:, 0].astype(np.int16), body[:, 1:].copy()
    edges = np.flatnonzero(np.diff(kinds, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        kind, part = kinds[a], rows[a:b]
        above = rows[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:
            part[:] = np.cumsum(part.reshape(b - a, -1, pixel), axis=1, dtype=np.uint8).reshape(part.shape)
        elif kind == 2:
            part[0] += above
            part[:] = np.cumsum(part, axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for row in part:
                line, before = row.reshape(-1, pixel).astype(np.int32), above.reshape(-1, pixel).astype(np.int32)
                west = corner = np.zeros(pixel, np.int32)
                for i, north in enumerate(before):
                    if kind == 3:
                        guess = (west + north) // 2
                    else:
                        near = np.abs(np.stack([north - corner, west - corner, west + north - 2 * corner]))
                        guess = np.choose(near.argmin(0), [west, north, corner])
                    west = line[i] = (line[i] + guess) & 255
                    corner = north
                row[:] = line.reshape(-1)
                above = row
        elif kind:
            raise ValueError(f"unknown row filter {kind}")
    return rows


def from_png(image: bytes) -> np.ndarray:
    """Samples (rows x bytes a row) of an 8-bit, non-interlaced image. A damaged file raises ValueError."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, head, ended = 8, [], None, False
    while at < len(image) and not ended:
        if at + 12 > len(image) or at + 12 + int.from_bytes(image[at : at + 4], "big") > len(image):
            raise ValueError("image is cut inside a chunk")
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("header of the wrong size")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("image is cut short")
    width, height, depth, colour, _, _, interlaced = head
    samples = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or samples is None or interlaced:
        raise ValueError("only 8-bit images without palette or interlacing are read")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError("samples can't be unpacked") from e
    if not height or len(raw) != height * (width * samples + 1):
        raise ValueError("samples don't fill the image")
    return _unfilter(raw.reshape(height, width * samples + 1), samples)


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def _thumbnail(samples: np.ndarray) -> np.ndarray:
    """Grey means over a SIDE x SIDE grid (rows are repeated where there are fewer)."""
    grey = samples.reshape(len(samples), WIDTH // 2, -1).mean(2)
    if len(grey) < SIDE:
        return grey[np.arange(SIDE) * len(grey) // SIDE]
    edges = np.arange(SIDE + 1) * len(grey) // SIDE
    return np.add.reduceat(grey, edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hashes(grids: np.ndarray) -> np.ndarray:
    """8 bytes for each grid: which low-frequency coefficients exceed their median."""
    c = _cosines()
    low = (c @ grids @ c.T).reshape(len(grids), -1)
    low[:, 0] = 0
    return np.packbits(low > np.median(low, axis=1, keepdims=True), axis=1)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (UTF-8 bytes without padding), png (the stored image)."""

    def run(batches):
        for part in chunks(batches):
            texts = [(x or "").encode() for x in part.column("text").to_pylist()]
            images = [to_png(x + b" " * (-len(x) % ROW or (0 if x else ROW))) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "png"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, png binary")


def decode(media: DataFrame) -> DataFrame:
    """The rows of ``encode`` with payload (the samples read back), phash (8 bytes) and damage.

    A damaged image has neither and its fault in ``damage``; the others' is null.
    """

    def read(image: bytes | None) -> np.ndarray | str:
        try:
            samples = from_png(image or b"")
            if samples.shape[1] != ROW:
                raise ValueError("image of another width")
            return samples
        except ValueError as e:
            return str(e)

    def run(batches):
        for part in chunks(batches, "png"):
            images = [read(x) for x in part.column("png").to_pylist()]
            good = [x for x in images if not isinstance(x, str)]
            hashes = iter(cosine_hashes(np.stack([_thumbnail(x) for x in good])) if good else ())
            rows = [(None, None, x) if isinstance(x, str) else (x.tobytes(), next(hashes).tobytes(), None) for x in images]
            found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, "payload", "phash", "damage"])

    return media.select("doc_id", "n_bytes", "png").mapInArrow(run, "doc_id long, n_bytes long, png binary, payload binary, phash binary, damage string")
