"""Elias-Fano sequences over numpy, with batch access and successor search, and their files.

A monotone sequence of n numbers below a universe is kept as low parts of whole bytes and a unary
vector of the high parts; running bit counts of 64-bit words give select. All queries are batches.
Files hold named arrays and are memory-mapped, so a reader's pages are shared by all processes.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np

SLICE = 1 << 17
FLIP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bit_words(ones: np.ndarray, size: int) -> np.ndarray:
    bits = np.zeros(-(-max(size, 1) // 64) * 64, np.uint8)
    bits[ones] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, flip: np.uint64 = np.uint64(0)) -> np.ndarray:
    """Position of the k-th (from 0) set bit, or with FLIP unset bit; before: such bits before each word."""
    at = np.searchsorted(before, k.astype(before.dtype), side="right") - 1  # of one kind, or all of before is converted
    out = np.empty(len(k), np.int64)
    for s in range(0, len(k), SLICE):
        part = slice(s, s + SLICE)
        word, rest = words[at[part]] ^ flip, (k[part] - before[at[part]]).astype(np.uint8)
        found = np.zeros(len(word), np.uint8)
        for width in (32, 16, 8, 4, 2, 1):  # halve the part of the word that has the bit
            low = word & np.uint64((1 << width) - 1)
            count = np.bitwise_count(low)
            above = rest >= count
            rest -= np.where(above, count, np.uint8(0))
            found += np.where(above, np.uint8(width), np.uint8(0))
            word = np.where(above, word >> np.uint64(width), low)
        out[part] = at[part] * 64 + found
    return out


def _next_zero(words: np.ndarray, before: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The position of the k-th unset bit, which is the first at or after ``at``: mostly in the same word."""
    left = (words[np.minimum(at >> 6, len(words) - 1)] ^ FLIP) >> (at & 63).astype(np.uint64)
    out = at + np.bitwise_count((left & -left) - np.uint64(1))
    far = np.flatnonzero(left == 0)
    out[far] = _select(words, before, k[far], FLIP)
    return out


class EliasFano:
    """Reads the arrays that ``encode`` makes."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str) -> None:
        self.n, self.low_bytes, self.buckets = (int(x) for x in arrays[f"{name}.head"])
        self.low, self.high, self.ones, self.zeros = (arrays[f"{name}.{x}"] for x in ("low", "high", "ones", "zeros"))

    @staticmethod
    def encode(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
        """Arrays of a sorted sequence of numbers below ``universe``."""
        n = len(values)
        values = values.astype(np.uint64)
        low_bytes = 0
        while n and (universe >> (8 * low_bytes)) > 4 * n + 64:
            low_bytes += 1
        shift = np.uint64(8 * low_bytes)
        low = values.view(np.uint8).reshape(-1, 8)[:, :low_bytes].T.copy() if n else np.zeros((low_bytes, 0), np.uint8)
        top = (values >> shift).astype(np.int64) if low_bytes < 8 else np.zeros(n, np.int64)
        buckets = (universe >> (8 * low_bytes)) + 1
        size = n + buckets
        high = _bit_words(top + np.arange(n), size)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate(([0], np.cumsum(count)))
        zeros = np.arange(len(ones)) * 64 - ones
        kind = np.uint32 if size < 1 << 32 else np.int64
        return {f"{name}.head": np.array([n, low_bytes, buckets]), f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones.astype(kind), f"{name}.zeros": zeros.astype(kind)}

    def _lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for b in range(self.low_bytes):
            out |= self.low[b][at].astype(np.int64) << (8 * b)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at positions."""
        top = _select(self.high, self.ones, at) - at
        return (top << (8 * self.low_bytes)) | self._lows(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The position of each value, -1 where it isn't in the sequence (its successor differs).

        Only what the values need is read: the time does not grow with the sequence.
        """
        if not self.n or not len(values):
            return np.full(len(values), -1)
        values = values.astype(np.int64)
        top, rest = values >> (8 * self.low_bytes), values & ((1 << (8 * self.low_bytes)) - 1)
        known = top < self.buckets
        top = np.where(known, top, 0)
        begin = np.where(top > 0, _select(self.high, self.zeros, np.maximum(top - 1, 0), FLIP) + 1, 0)
        low, stops = begin - top, _next_zero(self.high, self.zeros, begin, top) - top
        open_ = np.flatnonzero(known & (low < stops))
        a, b, wanted = low[open_], stops[open_], rest[open_]
        while len(open_):  # first position whose low part is at least the rest
            mid = (a + b) >> 1
            less = self._lows(mid) < wanted
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            low[open_] = a
            left = np.flatnonzero(a < b)
            open_, a, b, wanted = open_[left], a[left], b[left], wanted[left]
        hit = known & (low < stops)
        hit &= self._lows(np.where(hit, low, 0)) == rest
        return np.where(hit, low, -1)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write named arrays as one file; a repeated write of a task replaces it as a whole."""
    index, parts, at = {}, [], 0
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        index[name] = (a.dtype.str, a.shape, at)
        parts.append(a.tobytes() + b"\0" * (-a.nbytes % 64))
        at += len(parts[-1])
    head = json.dumps(index).encode()
    data = len(head).to_bytes(64, "little") + head + b"\0" * (-len(head) % 64) + b"".join(parts)
    place = urlparse(uri)
    if place.scheme in ("", "file"):
        os.makedirs(os.path.dirname(place.path), exist_ok=True)
        own = f"{place.path}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, place.path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path))
        with store.open_output_stream(path) as f:
            f.write(data)


@lru_cache(4096)
def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped. Files of a store that can't be mapped are copied first."""
    place = urlparse(uri)
    if place.scheme in ("", "file"):
        path = place.path
    else:
        import tempfile

        from pyarrow import fs

        store, there = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(there) as f, tempfile.NamedTemporaryFile(delete=False) as own:
            while block := f.read(1 << 24):
                own.write(block)
        path = own.name
    data = np.memmap(path, np.uint8, "r")
    if place.scheme not in ("", "file"):
        os.unlink(path)  # the map keeps the copy until it is closed
    size = int.from_bytes(data[:64].tobytes(), "little")
    start = 64 + size + -size % 64
    data, out = data.view(np.ndarray), {}  # memmap's own indexing is slow
    for name, (kind, shape, at) in json.loads(data[64 : 64 + size].tobytes()).items():
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = data[start + at : start + at + n].view(kind).reshape(shape)
    return out
