"""Media columns: lossless PNG in binary columns, and low-frequency cosine-transform hashes.

``png_encode`` and ``png_decode`` cover 8-bit greyscale images without
interlacing. Decoding tests the signature, each chunk's CRC-32, the header and
the size of the inflated data (zlib tests its own Adler-32), and undoes all
five row filters with numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_batches, picked, struct_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _neighbours(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left, upper and upper-left samples, zero outside the image."""
    left, up, corner = np.zeros_like(img), np.zeros_like(img), np.zeros_like(img)
    left[:, 1:], up[1:], corner[1:, 1:] = img[:, :-1], img[:-1], img[:-1, :-1]
    return left, up, corner


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))


def _coded(img: np.ndarray) -> np.ndarray:
    """The image as each of the five row filters codes it."""
    left, up, corner = _neighbours(img)
    average = ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
    return img - np.stack([np.zeros_like(img), left, up, average, _paeth(left, up, corner)])


def least_filters(coded: np.ndarray) -> np.ndarray:
    """For each row the filter with the least sum of absolute differences, the first of equals."""
    return np.abs(coded.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0).astype(np.uint8)


def png_encode(img: np.ndarray, level: int = 6, filters: np.ndarray | None = None) -> bytes:
    """``img``: uint8, rows by columns, neither empty. ``filters``: a filter type per row; ``least_filters`` unless given."""
    height, width = img.shape
    coded = _coded(img)
    filters = least_filters(coded) if filters is None else np.asarray(filters, np.uint8)
    raw = np.empty((height, width + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = filters, coded[filters, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


#: Samples that are unfiltered at once.
_STACK = 1 << 21


def _unfilter_stack(filters: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of images of one size (image, row, column), by diagonals.

    A sample needs those to its left, above, and above to the left; so all
    samples of an anti-diagonal, of all images, are undone at once.
    """
    count, height, width = rows.shape
    out = np.zeros((count, height + 1, width + 1), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height - 1, d) + 1)
        x = d - y
        kind = filters[:, y]
        a, b, c = out[:, y + 1, x], out[:, y, x + 1], out[:, y, x]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        guess = np.choose(kind, (np.zeros_like(a), a, b, (a + b) >> 1, paeth))
        out[:, y + 1, x + 1] = (rows[:, y, x] + guess) & 255
    return out[:, 1:, 1:].astype(np.uint8)


def unfilter(images: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Undo the filters of images (filters, rows) of one width; those of like height are undone together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(images)
    if any(len(f) and f.max() > PAETH for f, _ in images):
        raise ValueError("PNG: unknown row filter")
    order = sorted(range(len(images)), key=lambda k: len(images[k][0]))
    while order:
        height, width = images[order[-1]][1].shape
        n = max(1, _STACK // (height * width))
        some, order = order[-n:], order[:-n]
        filters, rows = np.zeros((len(some), height), np.uint8), np.zeros((len(some), height, width), np.uint8)
        for i, k in enumerate(some):
            filters[i, : len(images[k][0])], rows[i, : len(images[k][0])] = images[k]
        for k, img in zip(some, _unfilter_stack(filters, rows)):
            out[k] = img[: len(images[k][0])]
    return out


def png_parse(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Row filters and filtered rows of an 8-bit greyscale PNG; raises ValueError if any test fails."""
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: wrong signature")
    at, parts, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("PNG: cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"PNG: checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG: not an 8-bit greyscale image, or without its end")
    width, height = head[:2]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"PNG: {e}") from e
    if raw.size != height * (width + 1):
        raise ValueError("PNG: wrong amount of data")
    raw = raw.reshape(height, width + 1)
    return raw[:, 0], raw[:, 1:]


def png_decode(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; raises ValueError if any test fails."""
    return unfilter([png_parse(data)])[0]


def _shrink(img: np.ndarray, n: int) -> np.ndarray:
    """Area means of ``n`` equal spans along axis 0; a sample that a span's end cuts counts for its part."""
    height = img.shape[0]
    at = np.arange(n + 1) * height / n
    low = np.minimum(at.astype(np.int64), height - 1)
    starts, where = np.unique(low, return_inverse=True)
    sums = np.add.reduceat(img, starts, axis=0, dtype=np.float64)
    before = np.concatenate([np.zeros((1, img.shape[1])), np.cumsum(sums, axis=0)])[where]
    return np.diff(before + (at - low)[:, None] * img[low], axis=0) * (n / height)


_SIDE, _KEPT = 32, 8
_COSINES = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5)[None] * np.arange(_KEPT)[:, None])


def dct_hash(img: np.ndarray) -> str:
    """64 bits as 16 hex digits: which of the 8 by 8 lowest frequencies of the 32 by 32 area means exceed their median."""
    small = _shrink(_shrink(img, _SIDE).T, _SIDE).T
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def store_payload(payload: bytes, width: int, level: int) -> bytes:
    return png_encode(np.frombuffer(payload, np.uint8).reshape(-1, width), level)


def padded(data: bytes, width: int) -> bytes:
    """``data`` with bytes 0 appended up to a positive multiple of ``width``."""
    return data + bytes(-len(data) % width or (width if not data else 0))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, level: int = 6) -> DataFrame:
    """Store each text as an image, ``width`` samples wide.

    Returns ``id_col``, n_bytes and the PNG in the binary column media; other
    columns are not read. A null text counts as empty, an empty text is one row
    of zeros. Rows are independent: ties, repeated rows and null ids stay.
    """

    rows = picked(docs, __id=id_col, __text=text_col).withColumn("__text", F.col("__text").cast("binary"))

    def encode(batch):
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        return {"__id": batch.column(0), "n_bytes": [len(x) for x in texts], "media": [store_payload(padded(x, width), width, level) for x in texts]}

    return map_batches(rows, struct_of(__id=kind_of(rows, "__id"), n_bytes="long", media="binary"), encode).withColumnRenamed("__id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read stored images back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A stored form that fails a checksum raises: it means a damaged table.
    """
    rows = picked(media, __id=id_col, n_bytes="n_bytes", media="media")
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def decode(batch):
        stored = batch.column(2).to_pylist()
        found = []
        at = 0
        while at < len(stored):
            end, size, images = at, 0, []
            while end < len(stored) and (end == at or size < 4 * _STACK):
                images.append(png_parse(stored[end]))
                size += images[-1][1].size
                end += 1
            for data, img in zip(stored[at:end], unfilter(images)):
                payload = img.tobytes()
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), dct_hash(img)))
            at = end
        return {"__id": batch.column(0), "n_bytes": batch.column(1)} | dict(zip(names, zip(*found)))

    kinds = dict.fromkeys(names, "string") | dict.fromkeys(("payload_bytes", "tail_crc32", "media_bytes"), "long")
    return map_batches(rows, struct_of(__id=kind_of(rows, "__id"), n_bytes="long", **kinds), decode).withColumnRenamed("__id", id_col)
