"""Words of Arrow string columns and their hashes, by numpy over the column's bytes.

A text's words are its runs of bytes other than space and 0x09-0x0D. Every word gets a 64-bit hash from prefix
sums of a random polynomial over its bytes; words over ``LONG`` bytes are hashed one by one with xxhash. Window
hashes combine the hashes of consecutive words in the same way. The fixed tables come from a seeded generator, so
every executor gets the same hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
BLOCK, LONG = 1 << 20, 256
_gen = np.random.default_rng(20240611)
_BYTE = _gen.integers(0, 2**64, 256, dtype=U)
_LOWERED = _BYTE.copy()
_LOWERED[65:91] = _BYTE[97:123]
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(n, b, U))]) for b in (base, pow(base, -1, 2**64)))


_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 & ~7 | 5, 0xD6E8FEB86659FD93 & ~7 | 5
_byte_powers: list = []
_word_powers: list = []


def powers(kind: list, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not kind or len(kind[0][0]) <= n:
        kind[:] = [_powers(base, max(n, BLOCK + 1024))]
    return kind[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(33))
        h = h * U(0xFF51AFD7ED558CCD)
        h ^= h >> U(33)
        h *= U(0xC4CEB9FE1A85EC53)
        h ^= h >> U(33)
    return h


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data``, each text's first word (one more at the end), and hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def windows(self, n: int) -> np.ndarray:
        """A hash for each word with ``n - 1`` words after it; only those inside one text are meaningful."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, U)
        up, down = powers(_word_powers, _WORD_BASE, len(h))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U), np.cumsum(h * up[: len(h)])])
            return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


#: Gaps for classifiers: every ASCII byte but letters.
NO_LETTER = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])


def prefixes(w: Words, k: int) -> np.ndarray:
    """A hash of the first ``k`` bytes, lower-cased, of every word; 0 for words that are not longer."""
    out = np.zeros(len(w.starts), U)
    long = np.flatnonzero(w.ends - w.starts > k)
    up, _ = powers(_byte_powers, _BYTE_BASE, BLOCK)
    with np.errstate(over="ignore"):
        total = np.full(len(long), U(k * 0x9E3779B1), U)
        for j in range(k):
            total += _LOWERED[w.data[w.starts[long] + j]] * up[j]
    out[long] = mix(total)
    return out


def read(column: pa.Array, lower: bool = False, gap: np.ndarray = _GAP) -> Words:
    """The words of a column with their hashes; with ``lower``, A-Z count as a-z."""
    w = words_only(column, gap)
    w.hash = _hashes(w.data, w.starts, w.ends, lower)
    return w


def words_only(column: pa.Array, gap: np.ndarray = _GAP) -> Words:
    """The words of a column without hashes."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    base, top = int(offsets[0]), int(offsets[-1])
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[base:top] if held is not None and top > base else np.zeros(0, np.uint8)
    offsets = offsets - base
    if not len(data):
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64), np.zeros(0, U))
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), np.zeros(0, U))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    out = np.empty(len(starts), U)
    lut = _LOWERED if lower else _BYTE
    up, down = powers(_byte_powers, _BYTE_BASE, BLOCK)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, side="right")))
            lo, hi = int(starts[a]), int(ends[b - 1])
            if hi - lo <= BLOCK:
                total = np.concatenate([np.zeros(1, U), np.cumsum(lut[data[lo:hi]] * up[: hi - lo])])
                s, e = starts[a:b] - lo, ends[a:b] - lo
                out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
            a = b
    for i in np.flatnonzero(ends - starts > LONG):
        word = data[starts[i] : ends[i]].tobytes()
        out[i] = xxhash.xxh3_64_intdigest(word.translate(_TO_LOWER) if lower else word)
    return out


def slices(batch: pa.RecordBatch, text: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of text, one row at least."""
    n = np.asarray(pc.binary_length(batch.column(text).fill_null("")).to_numpy(zero_copy_only=False), np.int64)
    total, a = np.cumsum(n), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b
