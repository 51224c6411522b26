"""Vectorised word scanning and hashing over Arrow string buffers, shared by the text operators.

Words are hashed as polynomials over random byte values modulo 2**64 and then mixed; a table maps upper case to the value
of lower case, so folding A-Z costs nothing. Equal words always have equal hashes; operators that must be exact compare
texts or 64-bit sets after that.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer document is worked on alone.
CHUNK = 1 << 20
#: The same for operators whose arrays are many times the text.
SMALL_CHUNK = 1 << 18

#: Bytes over which words are hashed at a time.
STRETCH = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (xor-shift-multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


@cache
def byte_values(seed: int = 1, fold: bool = True) -> np.ndarray:
    values = np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
    if fold:
        values[65:91] = values[97:123]
    return values


def in_ranges(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Bytes of words: everything but space and \\x09-\\x0D.
NOT_SPACE = ~in_ranges((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words: digits, letters and whatever is not ASCII.
ALNUM = in_ranges((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: For bytes.translate: ASCII to lower case, and bytes outside words to a space.
ALNUM_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] else 32 for b in range(256))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null has no bytes."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of documents lo..hi: starts, ends (in ``data``), doc (from 0), first (index of each document's first word)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, table: np.ndarray, kinds: np.ndarray | None = None):
        """``kinds`` cuts words further: between bytes of different kinds from 1 to 3, and between any two of kind 2."""
        a, b = int(offsets[lo]), int(offsets[hi])
        self.data = data[a:b]
        at = offsets[lo : hi + 1] - a
        inside = np.zeros(b - a + 1, dtype=bool)
        np.take(table, self.data, out=inside[:-1])
        before = np.empty(b - a, dtype=bool)
        if b > a:
            before[0] = False
            before[1:] = inside[:-2]
            breaks = at[:-1][at[:-1] < b - a]
            before[breaks] = False
            if kinds is not None:
                kind = kinds[self.data]
                x, y = kind[:-1], kind[1:]
                cut = ((x != y) | (y == 2)) & (x - 1 < 3) & (y - 1 < 3)
                before[1:] &= ~cut
            starts = np.flatnonzero(inside[:-1] & ~before)
            after = inside[1:].copy()
            after[breaks[breaks > 0] - 1] = False
            if kinds is not None:
                after[:-1] &= ~cut
            self.starts, self.ends = starts, np.flatnonzero(inside[:-1] & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, at)
        self.n_docs = hi - lo
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        self.table = table

    def hashes(self, seed: int = 1, fold: bool = True) -> np.ndarray:
        """A hash of each word; worked out for stretches of words, so that tables and arrays stay small however long the text is."""
        with np.errstate(over="ignore"):
            return self._hashes(seed, fold)

    def _hashes(self, seed: int, fold: bool) -> np.ndarray:
        out = np.zeros(len(self.starts), np.uint64)
        values = np.where(self.table, byte_values(seed, fold), np.uint64(0))
        power, inverse = _powers()
        lo = 0
        while lo < len(out):
            base = int(self.starts[lo])
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + STRETCH, "right")))
            starts, end = self.starts[lo:hi] - base, int(self.ends[hi - 1])
            if end - base <= STRETCH:
                weighed = values[self.data[base:end]]
                weighed *= power[: end - base]
                out[lo:hi] = np.add.reduceat(weighed, starts) * inverse[starts]
            else:  # one very long word
                shift = np.uint64(1)
                for at in range(base, end, STRETCH):
                    part = values[self.data[at : min(at + STRETCH, end)]]
                    out[lo] += (part * power[: len(part)]).sum() * shift
                    shift *= power[-1] * _BASE
            lo = hi
        return mix(out + (self.ends - self.starts).astype(np.uint64))

    def runs_of(self, hashes: np.ndarray, doc: int, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` words of one document."""
        a, b = self.first[doc], self.first[doc + 1]
        return _run_hashes(hashes[a:b], n)

    def runs(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of all runs of ``n`` words of one document."""
        if len(hashes) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(hashes) - n + 1] == self.doc[n - 1 :])
        return at, _run_hashes(hashes, n)[at]


def _run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    last = max(len(hashes) - n + 1, 0)
    total, factor = np.full(last, n, np.uint64), _factors(n)
    for k in range(n):
        total += hashes[k : k + last] * factor[k]
    return mix(total)


@cache
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(STRETCH - 1, x, np.uint64)])) for x in (_BASE, inverse))


class Memo:
    """A hash table from unsigned 64-bit hashes to entries numbered from 0, looked up and filled by whole arrays. It grows when half full."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.bits = bits
        self.keys, self.entries = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entries of the hashes, -1 where there is none."""
        place = self._places(hashes)
        out = self.entries[place]
        off = np.flatnonzero((out >= 0) & (self.keys[place] != hashes))
        place = place[off]
        while len(off):
            place = place + 1 & (1 << self.bits) - 1
            found = self.entries[place]
            right = (found < 0) | (self.keys[place] == hashes[off])
            out[off[right]] = found[right]
            place, off = place[~right], off[~right]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """New, distinct hashes get the next entries in order."""
        total = self.n + len(hashes)
        if 2 * total > 1 << self.bits:
            there = np.flatnonzero(self.entries >= 0)
            keys, entries = self.keys[there], self.entries[there]
            self._empty((2 * total).bit_length())
            self._put(keys, entries)
        self._put(hashes, np.arange(self.n, total, dtype=np.int32))
        self.n = total

    def _put(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        place = self._places(hashes)
        while len(hashes):
            first = np.zeros(len(place), dtype=bool)
            first[np.unique(place, return_index=True)[1]] = True
            put = first & (self.entries[place] < 0)
            self.keys[place[put]], self.entries[place[put]] = hashes[put], entries[put]
            hashes, entries, place = hashes[~put], entries[~put], place[~put] + 1 & (1 << self.bits) - 1
