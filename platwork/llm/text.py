"""Words, hashes and n-grams of whole Arrow slices as numpy columns.

Texts of a slice lie one behind the other in one byte buffer; words are spans of it that
never cross a text's end. A null text has no words. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

#: A word character is any byte but blank, tab, line feed, VT, FF and carriage return.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, small letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about `size` bytes; a longer text is one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(length.astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes and the offsets of their starts (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span; spans ascend and do not overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, "right")))
        low, n = int(start[i]), int(end[j - 1] - start[i])
        if not _powers or len(_powers[0]) <= n:
            for _ in range(len(_powers)):
                _powers.pop()
            for base in (_BASE, _INVERSE):
                steps = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
                steps[0] = 1
                _powers.append(np.cumprod(steps, dtype=np.uint64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data[low : low + n]] * _powers[0][:n], out=sums[1:])
        a = start[i:j] - low
        out[i:j] = (sums[end[i:j] - low] - sums[a]) * _powers[1][a] + (end[i:j] - start[i:j]).astype(np.uint64)
        i = j
    return mix(out)


@dataclass
class Words:
    """Words of a slice: their spans, the text each belongs to, hashes."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and the count of all at the end
    doc: np.ndarray
    hash: np.ndarray | None = None

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: pa.Array, kind: np.ndarray = NOT_BLANK, lower: bool = False, hashed: bool = True) -> Words:
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(first))
    return Words(data, offsets, start, end, first, doc, span_hashes(data, start, end) if hashed else None)


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-grams that lie in one text, and their hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolled = hashes[:m].copy()
    for j in range(1, n):
        rolled *= _ROLL
        rolled += hashes[j : m + j]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return at, mix(rolled[at])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once. A table of counts by slot leaves few to be sorted."""
    n = len(keys)
    if n < 2:
        return np.zeros(n, bool)
    bits = max(8, int(4 * n - 1).bit_length())
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    order = np.argsort(keys[maybe])
    ranked = keys[maybe][order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(maybe), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    out = np.zeros(n, bool)
    out[maybe[twice]] = True
    return out


def covered(total: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which of `total` positions lie in a span of n that starts at one of `at`."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, at, 1)
    np.subtract.at(step, np.minimum(at + n, total), 1)
    return np.cumsum(step[:-1]) > 0


def sums_by_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of `flags` between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one behind the other."""
    n = last - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers as bytes, all first bytes, then all second ones and so on, compressed."""
    planes = np.concatenate([c.astype(np.int64).view(np.uint8).reshape(-1, 8).T.reshape(-1) for c in columns])
    return len(planes).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n, codec="zstd", asbytes=True), np.uint8)
    rows = n // 8 // columns
    return np.ascontiguousarray(planes.reshape(columns, 8, rows).transpose(0, 2, 1)).view(np.int64).reshape(columns, rows)
