"""Integers packed for shuffles, and chunks of documents that are worked on at once.

A shuffle of n-grams as rows costs about 30 bytes each. Here each chunk sends
one row to each range of keys, with the keys' differences and their values by
bytes of equal weight and compressed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of unsigned integers, one to one."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


#: What is shorter isn't compressed.
_SHORT = 128


def planes(x: np.ndarray) -> bytes:
    """Integers from 0: the width of the largest in bytes, the length of what follows, and all lowest bytes, all second ones and so on.

    Zstandard codes planes of skewed values in a few bits, which the shuffle's own compression can't.
    """
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    raw = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    short = pa.compress(raw, codec="zstd", asbytes=True) if len(raw) >= _SHORT else raw
    return struct.pack("<BI", width, len(short)) + short


def from_planes(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    """``columns`` arrays of ``n`` integers that ``planes`` made, one after the other."""
    out, at = [], 0
    for _ in range(columns):
        width, size = struct.unpack_from("<BI", data, at)
        raw = data[at + 5 : at + 5 + size]
        if width * n >= _SHORT:
            raw = pa.decompress(raw, width * n, codec="zstd", asbytes=True)
        cells = np.zeros((n, 8), np.uint8)
        if width:
            cells[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
        out.append(cells.view("<u8").ravel())
        at += 5 + size
    return out


def packed_ranges(keys: np.ndarray, values: Sequence[np.ndarray], key_bits: int, range_bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Sorted keys of ``key_bits`` bits with values, cut into 2^range_bits ranges: range, number of keys, packed keys and values."""
    shift = key_bits - range_bits
    cuts = np.searchsorted(keys, np.arange((1 << range_bits) + 1, dtype=_U64) << _U64(shift))
    for p in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        lo, hi = int(cuts[p]), int(cuts[p + 1])
        yield p, hi - lo, planes(np.diff(keys[lo:hi], prepend=_U64(p << shift))) + b"".join(planes(v[lo:hi]) for v in values)


def unpacked_range(p: int, n: int, data: bytes, columns: int, key_bits: int, range_bits: int) -> list[np.ndarray]:
    """Keys and ``columns`` values of a range."""
    steps, *values = from_planes(data, n, columns + 1)
    return [np.cumsum(steps, dtype=_U64) + _U64(p << (key_bits - range_bits)), *values]


def range_bits_for(entries: int, most: int, limit: int) -> int:
    """So many bits that a range of random keys has about ``most`` entries at most."""
    return min(limit, max(0, (max(entries, 1) - 1) // most).bit_length())
