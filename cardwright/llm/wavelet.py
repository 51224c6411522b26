"""Wavelet matrix over a sequence of token ids: bit planes with rank and select, in one block of bytes.

Layout (little endian): magic, then the header's counts, the alphabet (ids that occur, ascending), document ids and ends,
and for each plane the number of zeros, ones before each block of 512 bits, and the bits. Ids are coded by their place in
the alphabet, which takes as many planes as the shard's own number of distinct ids needs.
"""

import struct

import numpy as np

MAGIC = b"WVM1"
_HEADER = struct.Struct("<4sBxxxQQQ")
BLOCK = 512


def _padded(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits)
    return np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])


def build(ids: np.ndarray, doc_ids: np.ndarray, doc_ends: np.ndarray) -> bytes:
    """The file of the ids of documents; ``doc_ends`` has the number of ids up to each document's end."""
    seen = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    levels = max(1, int(len(seen) - 1).bit_length()) if len(seen) else 1
    code = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.uint16 if levels <= 16 else np.uint32)
    code[seen] = np.arange(len(seen), dtype=code.dtype)
    left = code[ids] if len(ids) else np.zeros(0, np.uint16)
    parts = [_HEADER.pack(MAGIC, levels, len(ids), len(doc_ids), len(seen)), seen.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), doc_ends.astype("<u8").tobytes()]
    for level in range(levels - 1, -1, -1):
        ones = (left >> left.dtype.type(level)) & left.dtype.type(1) != 0
        zeros = left[~ones]
        bits = _padded(ones)
        counts = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint64)
        before = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        parts += [struct.pack("<Q", len(zeros)), before.tobytes(), bits.tobytes()]
        left = np.concatenate([zeros, left[ones]])
    return b"".join(parts)


class WaveletMatrix:
    """Reads a file made by ``build``; arrays are views of its bytes."""

    def __init__(self, raw: bytes):
        magic, levels, self.n, n_docs, sigma = _HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.alphabet, self.doc_ids, self.doc_ends = take("<u4", sigma), take("<i8", n_docs), take("<u8", n_docs)
        blocks = -(-self.n // BLOCK)
        self.zeros, self.before, self.planes = [], [], []
        for _ in range(levels):
            self.zeros.append(int(take("<u8", 1)[0]))
            self.before.append(take("<u4", blocks + 1))
            self.planes.append(take("u1", blocks * BLOCK // 8))

    def _bit(self, level: int, i: np.ndarray) -> np.ndarray:
        return (self.planes[level][i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, within = i // BLOCK, i % BLOCK
        out = self.before[level][block].astype(np.int64)
        rows = np.minimum(block, max(len(self.planes[level]) // (BLOCK // 8) - 1, 0))
        if not len(self.planes[level]):
            return out
        bits = self.planes[level].reshape(-1, BLOCK // 8)[rows]
        whole = within // 8
        columns = np.arange(BLOCK // 8)
        out += np.where(columns < whole[..., None], np.bitwise_count(bits), 0).sum(-1, dtype=np.int64)
        last = np.take_along_axis(bits, np.minimum(whole, BLOCK // 8 - 1)[..., None], -1)[..., 0]
        return out + np.where(within % 8 > 0, np.bitwise_count(last >> (8 - within % 8).astype(np.uint8)), 0)

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the (k+1)-th ``bit``."""
        before = self.before[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = np.searchsorted(before, k, "right") - 1
        bits = np.unpackbits(self.planes[level].reshape(-1, BLOCK // 8)[block], axis=-1) == bit
        return block * BLOCK + (np.cumsum(bits, -1) == (k - before[block] + 1)[..., None]).argmax(-1)

    def access(self, positions) -> np.ndarray:
        """The ids at the positions."""
        i, code = np.atleast_1d(np.asarray(positions, np.int64)), 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i).astype(np.int64)
            ones = self._rank1(level, i)
            i = np.where(bit, self.zeros[level] + ones, i - ones)
            code = code * 2 + bit
        return self.alphabet[code].astype(np.int64)

    def _code(self, token: int) -> int:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else -1

    def _range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._rank1(level, np.array([lo, hi])).tolist()
            bit = code >> (len(self.planes) - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if bit else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the token among positions lo..hi (rank, for lo = 0)."""
        code = self._code(token)
        if code < 0:
            return 0
        a, b = self._range(code, max(lo, 0), self.n if hi is None else min(hi, self.n))
        return max(b - a, 0)

    def occurrences(self, token: int) -> np.ndarray:
        """Ascending positions of the token (select, for each k)."""
        code = self._code(token)
        if code < 0:
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(code, 0, self.n))
        for level in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return np.sort(at)

    def decode(self) -> np.ndarray:
        """All ids in order."""
        levels = len(self.planes)
        kind = np.uint16 if levels <= 16 else np.uint32
        code = np.zeros(self.n, kind)
        for level in range(levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[~ones] = code[: self.zeros[level]]
            up[ones] = code[self.zeros[level] :] | kind(1 << (levels - 1 - level))
            code = up
        return self.alphabet[code]

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends) of the documents within the shard."""
        ends = self.doc_ends.astype(np.int64)
        return self.doc_ids, np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends
