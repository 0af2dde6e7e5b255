"""Vectorised words, hashes and shingles over the byte buffers of Arrow string columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0xD6E8FEB86659FD95)
_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(CHUNK_BYTES + 1, n)
        up = np.full(size, _BASE, dtype=np.uint64)
        up[0] = 1
        down = np.full(size, _U(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
        down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def give_back() -> None:
    """Return freed memory to the system: workers live on, for other operators too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Chunk(NamedTuple):
    """Rows first..first+len(offsets)-1 of a batch: their bytes and where each text starts (and the last ends)."""

    first: int
    offsets: np.ndarray
    data: np.ndarray


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a string column without copying; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + chunk_bytes, "right")) - 1)
        yield Chunk(i, offs[i : j + 1] - offs[i], raw[offs[i] : offs[j]])
        i = j


class Words(NamedTuple):
    """Words of a chunk: first and last+1 byte, and the words of text d are first[d]..first[d+1]-1."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words(chunk: Chunk, separator: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that aren't separators, never across texts."""
    offs, data = chunk.offsets, chunk.data
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(separator[data], out=inside[:-1])
    begins, after = inside.copy(), inside[:-1].copy()
    begins[1:] &= ~inside[:-1]
    edges = offs[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    after &= ~inside[1:]
    edges = offs[1:]
    edges = edges[edges > 0] - 1
    after[edges] = inside[edges]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(after) + 1
    return Words(starts, ends, np.searchsorted(starts, offs))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, mixed: equal words, equal hashes, wherever they stand."""
    if not len(w.starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[w.ends] - sums[w.starts]) * down[w.starts])


_STEP = _U(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; a shorter text's whole sequence is its only shingle."""
    n = len(hashes)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        if n > i:
            part = mix(hashes[i:] + _U((int(_STEP) * (i + 1)) % (1 << 64)))
            rolled[: n - i] += part
    rolled = mix(rolled)
    out = []
    for d in range(len(first) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif b > a:
            part = hashes[a:b] + _STEP * (np.arange(1, b - a + 1, dtype=np.uint64))
            out.append(mix(np.array([mix(part).sum(dtype=np.uint64) + _U(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], type=pa.binary())
