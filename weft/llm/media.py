"""Media columns: byte payloads as 8-bit grey PNG images, read back with checks, and cosine-transform hashes.

An image is written with the zlib and crc32 of the standard library, a filter for each row, into a binary column of a table, and
read from it by walking its chunks: every chunk's checksum is tested, the IDAT data is inflated, and the row filters are undone
with numpy. The feature is a hash of the low frequencies of a two-dimensional cosine transform.

Defined results: a null text counts as the empty one; the empty payload becomes 64 zero bytes, hence a 64 x 1 image;
equal texts, repeated rows among them, have equal values; a null id stays null; an empty table gives no rows; a very long text is
one image, held by one task; columns of the input other than those asked for are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weft.llm.common import Scratch, bounded_batches, own_worker

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Side of the square to which an image is averaged, and of the block of low frequencies that is kept.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_encode(payload: bytes, width: int = WIDTH, level: int = 2, row_filter: int | None = None) -> bytes:
    """payload's length must be a positive multiple of width. row_filter: 0 to 4 for all rows; None picks none, left or up row by row,
    the one whose bytes, taken as signed numbers, have the smallest sum of sizes (the first one on ties)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], up[1:] = rows[:, :-1], rows[:-1]
    lines = np.empty((len(rows), width + 1), np.uint8)
    if row_filter is None:
        shown = np.stack([rows, rows - left, rows - up])
        lines[:, 0] = np.minimum(shown, -shown).sum(axis=2, dtype=np.int64).argmin(axis=0)
        lines[:, 1:] = shown[lines[:, 0], np.arange(len(rows))]
    else:
        corner = np.zeros_like(rows)
        corner[1:, 1:] = rows[:-1, :-1]
        guess = _guess(np.full(len(rows), row_filter)[:, None], *(x.astype(np.int16) for x in (left, up, corner)))
        lines[:, 0], lines[:, 1:] = row_filter, rows - guess.astype(np.uint8)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def _guess(kind: np.ndarray, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What the row filters 0 to 4 subtract, from the neighbours to the left, above, and above to the left."""
    around = left + up - corner
    a, b, c = np.abs(around - left), np.abs(around - up), np.abs(around - corner)
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    return np.choose(kind, [np.zeros_like(left), left, up, (left + up) >> 1, nearest])


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undoes the filters of rows whose first byte names them; one byte a sample.

    Without average and Paeth rows, rows that look left are summed along themselves and stretches of rows that look up along
    their columns. With them, all rows advance together along diagonals: a diagonal needs the two before it alone.
    """
    kinds, raw = lines[:, 0], lines[:, 1:]
    if (kinds > 4).any():
        raise ValueError(f"unknown row filter {kinds.max()}")
    if not kinds.any():
        return raw
    if (kinds <= 2).all():
        out = raw.copy()
        out[kinds == 1] = np.cumsum(raw[kinds == 1], axis=1, dtype=np.uint8)
        up = kinds == 2
        turns = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]])))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            first = max(a - 1, 0)
            out[first:b] = np.cumsum(out[first:b], axis=0, dtype=np.uint8)
        return out
    n, width = raw.shape
    out = np.zeros((n + 1, width + 1), np.int16)
    for k in range(n + width - 1):
        i = np.arange(max(0, k - width + 1), min(n, k + 1))
        j = k - i
        out[i + 1, j + 1] = (raw[i, j] + _guess(kinds[i], out[i + 1, j], out[i, j + 1], out[i, j])) & 255
    return out[1:, 1:].astype(np.uint8)


def png_decode(image: bytes) -> np.ndarray:
    """The samples of an 8-bit grey image, one row each. Raises ValueError where a checksum or a length is wrong."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, shape, packed = 8, None, []
    while True:
        if at + 12 > len(image):
            raise ValueError("truncated")
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if len(data) != n or image[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError(f"checksum of {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", data)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit grey images without interlacing")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if shape is None or lines.size != shape[0] * shape[1]:
        raise ValueError("wrong size")
    return unfilter(lines.reshape(shape))


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None])


_BASIS = _cosines(SIDE, LOW)


def _averaged(m: np.ndarray, n: int) -> np.ndarray:
    """Averages of n equal stretches of the rows; a short image repeats rows."""
    edges = np.arange(n + 1) * len(m) // n
    starts = np.minimum(edges[:-1], len(m) - 1)
    sizes = np.maximum(edges[1:] - edges[:-1], 1)[:, None]
    if len(m) >= n:
        return np.add.reduceat(m, starts, axis=0) / sizes
    return m[starts]


def cosine_hash(samples: np.ndarray) -> bytes:
    """Eight bytes: whether each low frequency is above their median; then the quantised constant term is left out."""
    small = _averaged(samples.astype(np.float64), SIDE)
    small = small.reshape(SIDE, SIDE, -1).mean(axis=2) if samples.shape[1] % SIDE == 0 else _averaged(small.T, SIDE).T
    low = (_BASIS @ small @ _BASIS.T).round(6).ravel()
    low[0] = np.median(low[1:])
    return np.packbits(low > np.median(low)).tobytes()


STORED = "doc_id long, n_bytes long, media binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One image a row in a binary column, with the length of what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("media")
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            images = [png_encode(x + bytes(-len(x) % WIDTH if x else WIDTH)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(images, pa.binary())], names=[f.split()[0] for f in STORED.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, STORED)


def media_features(stored: DataFrame) -> DataFrame:
    """The figures of a binary column of images, all of them from the bytes read back. A damaged image raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("media")
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for image in batch.column(2).to_pylist():
                samples = png_decode(image)
                back = samples.tobytes()
                row = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples).hex())
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, batch.column(2)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


def media_columns(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Images are written to a table first; what is returned is read from it, with the images themselves in column media."""
    bounded_batches(spark)
    return media_features(Scratch(spark, "media").keep(store_media(docs, id_col, text_col), "images"))
