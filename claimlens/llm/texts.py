"""Whole texts as numpy arrays: words, their 64-bit hashes, and hashes of runs of units.

All operators read Arrow batches of whole texts. A batch is cut between documents into slices of a few
MB, so the arrays of one slice bound a task's memory; one longer text makes a slice of its own.
A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def trimmed() -> None:
    """Give freed memory back to the system: Spark keeps Python workers between tasks, and idle ones should be small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers modulo 2**64 of the fixed odd base, or of its inverse."""
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        base = np.full(size, _INVERSE if inverse else _ODD, np.uint64)
        base[0] = 1
        have = np.cumprod(base, dtype=np.uint64)
        if size <= 2 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Prefix sums of units times powers, from which :func:`run_hash` hashes any run."""
    out = np.empty(len(units) + 1, np.uint64)
    out[0] = 0
    np.cumsum(units * powers(len(units)), out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of units[start:end] for arrays of starts and ends: equal runs have equal hashes."""
    inverse = powers(len(sums), inverse=True)
    return mixed((sums[end] - sums[start]) * inverse[start] + mixed((end - start).astype(np.uint64)))


@dataclass
class Slice:
    """Some whole documents: ids, UTF-8 bytes laid end to end, and where each begins (one more for the end)."""

    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


@dataclass
class Words:
    """Words of a slice: hash, first byte, byte after the last, and where each document's words begin."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray

    def document(self) -> np.ndarray:
        """Index of each word's document."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, most: int = 1 << 30, text: str = "text", key: str = "doc_id") -> Iterator[Slice]:
    """Cut Arrow batches of (key, text) into slices of at most ``limit`` bytes and ``most`` rows, or one document."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string())
        n = len(column)
        if not n:
            continue
        buffers = column.buffers()
        at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
        ids = batch.column(batch.schema.get_field_index(key))
        ids = ids.to_numpy(zero_copy_only=False)
        first = 0
        while first < n:
            last = min(first + most, max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1))
            yield Slice(ids[first:last], data[at[first] : at[last]], at[first : last + 1] - at[first])
            first = last


def words(s: Slice, lower: bool = False, plain: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice; ``lower``: after lower-casing A-Z; ``plain``: also after
    reading ASCII punctuation as blanks."""
    data = PLAIN[s.data] if plain else LOWER[s.data] if lower else s.data
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, np.zeros(len(s) + 1, np.int64))
    solid = ~WHITE[data]
    begin = np.zeros(len(data) + 1, bool)
    begin[0] = True
    begin[s.offsets] = True  # no word crosses documents
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | begin[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | begin[1:])) + 1
    hashes = run_hash(prefix_sums(_BYTES[data]), start, end)
    return Words(hashes, start, end, np.searchsorted(start, s.offsets))


def byte_units(data: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each byte, for hashing runs of bytes."""
    return _BYTES[data]


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word sequences, at their first words' places, and whether each lies in one document."""
    n = len(w.hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    m = n - k + 1
    h = w.hashes[:m].copy()
    for j in range(1, k):
        h *= _ODD
        h ^= w.hashes[j : j + m]
    doc = w.document()
    return mixed(h), doc[:m] == doc[k - 1 :]


def hexes(blobs: list[bytes]) -> list[str]:
    import hashlib

    return [hashlib.sha256(b).hexdigest() for b in blobs]
