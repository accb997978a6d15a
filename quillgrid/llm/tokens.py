"""Words of many texts at once, as 64-bit hashes, without a Python object a word."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a text is never cut, so a longer one makes a larger slice.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_tables: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, at least ``n`` of each; one pair of tables, made longer when needed."""
    if len(_tables[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
            table[0] = 1
            _tables[k] = np.cumprod(table)
    return _tables[0], _tables[1]


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def translation(blank: bytes = b"") -> np.ndarray:
    """A byte table that lower-cases A-Z and turns white space (and the bytes of ``blank``) into spaces."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(_WHITE) + list(blank)] = 32
    return table


@dataclass
class Words:
    """Words of a slice of texts: ``doc`` is the text's index in the slice, nondecreasing."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    n_docs: int

    @property
    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    """Words of the texts ``data[bounds[i]:bounds[i + 1]]``."""
    data = table[data]
    n = len(data)
    inside = data != 32
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    begins = inside & (first[:n] | ~np.r_[False, inside[:-1]][:n])
    last = np.zeros(n + 1, bool)
    last[bounds] = True
    finishes = inside & (last[1:] | ~np.r_[inside[1:], False][:n])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[data] * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(bounds, starts, "right") - 1
    return Words(data, starts, ends, doc, hashes, len(bounds) - 1)


def hash_word(word: bytes) -> int:
    """The hash that :func:`words` gives to one word."""
    found = words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), np.arange(256, dtype=np.uint8))
    return int(found.hashes[0])


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, bounds) of stretches of a string column of about ``most`` bytes; nulls are empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    raw, offset = column.buffers(), column.offset
    offsets = np.frombuffer(raw[1], np.int64)[offset : offset + n + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
