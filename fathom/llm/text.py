"""Whole-batch word handling on byte buffers, shared by the text operators.

A word is a maximal run of bytes other than ASCII space and 0x09-0x0D.  Null texts have no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SEPARATORS = b" \t\n\v\f\r"
_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64)
_BLOCK = 1 << 18
_LIBC = ctypes.CDLL(None)
#: Bytes of text handled at once inside a task; a longer text is handled alone.
CHUNK_BYTES = 2 << 20


@dataclass
class Words:
    """Words of several texts: ``buf`` has each word followed by one space."""

    buf: np.ndarray  # uint8
    off: np.ndarray  # int64, word i is buf[off[i]:off[i+1]], its trailing space included
    first: np.ndarray  # int64, words of text d are first[d]:first[d+1]

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def joined(self, d: int) -> bytes:
        """Words of text ``d`` joined by one space."""
        a, b = self.first[d], self.first[d + 1]
        return self.buf[self.off[a] : self.off[b] - 1].tobytes() if b > a else b""

    def hashed(self) -> np.ndarray:
        """A 64-bit hash of every word, from its bytes and their places; made in blocks, which bounds the memory beside the text."""
        out = np.empty(self.n, np.uint64)
        if not self.n:
            return out
        edges = [0, *np.unique(np.searchsorted(self.off, np.arange(_BLOCK, len(self.buf), _BLOCK))).tolist(), self.n]
        power = np.cumprod(np.full(int(np.diff(self.off).max()), 0x9E3779B97F4A7C15, np.uint64))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            start = self.off[a:b] - self.off[a]
            raw = self.buf[self.off[a] : self.off[b]]
            place = np.arange(len(raw)) - np.repeat(start, np.diff(self.off[a : b + 1]))
            with np.errstate(over="ignore"):
                out[a:b] = mix(np.add.reduceat(_BYTE[raw] * power[place], start))
        return out

    def codes(self) -> np.ndarray:
        """A number for every word, equal for equal words only."""
        if not self.n:
            return np.zeros(0, np.int32)
        arr = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.off), pa.py_buffer(self.buf)])
        return arr.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def words_of(texts: list[bytes | None]) -> Words:
    """Split texts into words without a Python loop over words."""
    if not texts:
        return Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))
    parts = [t or b"" for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    start_of = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    sep = _SEP[raw]
    before = np.concatenate(([True], sep[:-1]))
    starts = np.flatnonzero(before & ~sep)
    keep = ~(sep & before)
    kept_sep = sep[keep]
    buf = raw[keep]
    buf[kept_sep] = 0x20
    off = np.concatenate(([0], np.flatnonzero(kept_sep) + 1)).astype(np.int64)
    return Words(buf, off, np.searchsorted(starts, start_of).astype(np.int64))


def from_packed(buf: bytes) -> Words:
    """Words of one packed string, each word followed by one space."""
    arr = np.frombuffer(buf, np.uint8)
    off = np.concatenate(([0], np.flatnonzero(arr == 0x20) + 1)).astype(np.int64)
    return Words(arr, off, np.array([0, len(off) - 1], np.int64))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Mixed 64-bit hash of every k consecutive values; len(h)-k+1 values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out *= np.uint64(base)
            out += h[j : j + n]
    return mix(out)


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of Arrow batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
        at, size = 0, 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if i > at and size + n > limit:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += n
        if at < len(texts):
            yield batch.slice(at), texts[at:]
    released()


def released() -> None:
    """Give what a task has freed back to the system, since its worker stays for later tasks of any kind."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)
