"""Encoding with a public tokenizer's own library, each distinct piece of text once."""

import os
from functools import cache

import numpy as np

from .hashing import NOT_SPACE, Memo, Words

#: Pieces remembered by a worker before it starts anew; bounds its memory to about 200 MB.
MEMO = 2_000_000
#: Text encoded at once for new pieces, and bytes of text worked on at a time.
JOINED, CHUNK = 20_000, 1 << 21

#: Kinds of bytes for cutting text: letters, digits, punctuation; 4 may not be cut off (apostrophes make contractions, <| opens
#: special tokens, control characters and all that is not ASCII depend on their surroundings).
_KINDS = np.full(256, 4, np.uint8)
_KINDS[33:127] = 3
_KINDS[[*range(65, 91), *range(97, 123)]] = 1
_KINDS[48:58] = 2
_KINDS[[ord(c) for c in "'<|>"]] = 4
_KINDS[[32, *range(9, 14)]] = 0


class PieceEncoder:
    """Token ids of texts for word-end vocabularies that drop white space, such as word_bpe_49k.json.

    For those, a text falls into pieces whose encodings are independent: between ASCII white space, and further between ASCII
    letters, digits and punctuation. The split pattern puts a border at each of these cuts, normalisation composes nothing
    across them, and no special token holds one. So the library encodes each distinct piece once, and texts are put
    together from the results. Pieces are known by 64-bit hashes of their bytes, upper case as lower case unless the
    texts at hand may hold a special token, whose own case counts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.memo = Memo()
        self.ids, self.at = np.zeros(1 << 16, self.kind), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        for k in range(0, len(pieces), JOINED):
            some, n = pieces[k : k + JOINED], self.memo.n
            found = self.library.encode(" ".join(some), add_special_tokens=False)
            starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in some])])
            ids = np.array(found.ids, self.kind)
            at = np.array([a for a, _ in found.offsets], np.int64)
            ends = np.searchsorted(at, starts[1:]) + self.used
            while len(self.ids) < self.used + len(ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while len(self.at) < n + len(some) + 1:
                self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.at[n + 1 : n + 1 + len(some)] = ends
            self.memo.add(hashes[k : k + JOINED])
            self.used += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of documents lo..hi one after another, number of ids of each)."""
        words = Words(data, offsets, lo, hi, NOT_SPACE, _KINDS)
        if not len(words.starts):
            return np.zeros(0, self.kind), np.zeros(hi - lo, np.int64)
        raw = words.data.tobytes()
        hashes = words.hashes(fold=b"<|" not in raw)
        if self.memo.n + len(hashes) > MEMO:
            self._clear()
        entry = self.memo.find(hashes)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            self._learn(new, [raw[a:b].decode() for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)])
            entry[missing] = self.memo.find(hashes[missing])
        lengths = self.at[entry + 1] - self.at[entry]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.at[entry] - (ends - lengths), lengths) + np.arange(ends[-1])]
        total = np.concatenate([[0], ends])
        return ids, np.diff(total[words.first])


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
