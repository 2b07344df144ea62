"""Whole texts as numpy byte arrays: words, runs and substring hashes of many documents at once.

Arrow hands a batch's texts over as one UTF-8 buffer with offsets.  Everything here works on
slices of about ``CHUNK`` bytes of that buffer, so memory stays bounded whatever the batch holds
(one longer document makes one longer slice).  Substring hashes have 64 bits and mix eight bytes at
a time without an algebraic structure that texts could meet; where a wrong match would write wrong
output (tokens, removed bytes), the operators compare the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: Strings longer than this are hashed one by one, so that a round of lanes isn't spent on few of them.
LONG_STRING = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: The separators of words: space and \\x09 to \\x0D.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    shifted = h >> np.uint64(32)
    h = h ^ shifted
    for _ in range(2):
        h *= np.uint64(0xD6E8FEB86659FD93)
        np.right_shift(h, np.uint64(32), out=shifted)
        h ^= shifted
    return h


@dataclass
class Chunk:
    """Documents lo..hi of a batch: their bytes, and where each begins (one more offset than documents)."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    def hasher(self, fold: np.ndarray | None = None) -> Hasher:
        return Hasher(self.buf if fold is None else fold[self.buf])


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One value of two, in this order."""
    out = a * _ODD
    out ^= out >> np.uint64(29)
    out += b
    return mix(out)


class Hasher:
    """Hashes of any substrings of a byte array, by their bytes alone."""

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        self.padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        #: The eight bytes from each place on, as one value.
        self.lanes = np.ndarray(len(buf) + 1, "<u8", self.padded.data, 0, (1,))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Eight bytes a round go through a non-linear mix, so no family of strings collides by its structure."""
        length = end - start
        out = mix(length.astype(np.uint64) * _ODD + np.uint64(1))
        big = np.flatnonzero(length > LONG_STRING)
        at = np.flatnonzero((length > 0) & (length <= LONG_STRING))
        place, left = start[at], length[at]
        while len(at):
            out[at] = mix(out[at] ^ (self.lanes[place] & MASKS[np.minimum(left, 8)])) + _ODD
            more = left > 8
            at, place, left = at[more], place[more] + 8, left[more] - 8
        for i in big.tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.buf[start[i] : end[i]], digest_size=8).digest(), "little")
        return out

    def every(self, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes (eight or more), by start."""
        n = len(self.buf) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.empty(n, np.uint64)
        for lo in range(0, n, 1 << 15):  # pieces that stay in the cache
            hi = min(n, lo + (1 << 15))
            part, size = mix(self.lanes[lo : hi + k - 8] + _ODD), 8
            while size * 2 <= k:
                part = _folded(part[:-size], part[size:])
                size *= 2
            out[lo:hi] = part if size == k else _folded(part[: hi - lo], part[k - size :])
        return out


def fold_table(fold: dict[int, int]) -> np.ndarray:
    """A table of bytes in which each key byte counts as its value."""
    t = np.arange(256, dtype=np.uint8)
    for k, v in fold.items():
        t[k] = v
    return t


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[Chunk]:
    """The documents of a column, in order, in slices of about ``limit`` bytes."""
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def words(c: Chunk, sep: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that aren't separators: starts, ends, and each document's first word (one more than documents)."""
    n = len(c.buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(c.offs), np.int64)
    gap = sep[c.buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    inner = c.offs[(c.offs > 0) & (c.offs < n)]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, c.offs)


def spans(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values, by start (the last k-1 starts have none)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _ODD
    for j in range(1, k):
        out ^= out >> np.uint64(31)
        out += hashes[j : j + n]
        out *= _ODD
    return mix(out)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one document, with each document's first gram.

    A document of 1 to k-1 words has one gram, of all its words; one without words has none.
    """
    n, count = len(hashes), np.diff(first)
    total = np.zeros(n, np.uint64)
    every = spans(hashes, k)
    total[: len(every)] = every
    left = np.repeat(first[1:], count) - np.arange(n)  # words from here to the end of the document
    keep = left >= k
    for m in range(1, k):
        at = first[:-1][count == m]
        if len(at):
            total[at] = spans(hashes, m)[at] ^ np.uint64(m)
            keep[at] = True
    return total[keep], np.concatenate([[0], np.cumsum(np.where(count >= k, count - k + 1, (count > 0).astype(np.int64)))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start..start+length of each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, l = starts[full].astype(np.int64), lengths[full].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(l)[:-1]])
    out[0] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + l[:-1] - 1)
    return np.cumsum(out)
