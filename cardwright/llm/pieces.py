"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

A text is cut wherever no piece of the model spans two neighbouring characters; what is left between cuts (about a word)
is searched once for each distinct one. Words of equal length advance together: from each place, hashes of substrings
probe the sorted keys of all pieces and their beginnings, and vectorised maxima keep the best way to each place and a
backpointer. In a unigram model a way's score is the sum of its pieces' scores. In a BPE model a way counts only if each
two neighbouring pieces stay apart when their joint text is merged by rank; a text has exactly one such way, which is
the library's result.
"""

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .hashing import Memo, chunks, mix, utf8
from .shared import tidy

SPACE = "▁"
#: Words a worker remembers before it starts anew, and bytes of text worked on at a time.
MEMO, CHUNK = 800_000, 3 << 18
#: Ids decoded at a time.
IDS = 1 << 18

_BASE = 0x9E3779B97F4A7C15


def _values(code: np.ndarray) -> np.ndarray:
    return mix(code.astype(np.uint64) + np.uint64(77)) | np.uint64(1)


@cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]))


class Decoder:
    """What is shown for each id; all that decoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        shown: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                shown.append(bytes([int(piece[3:5], 16)]))
            else:
                shown.append(b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else piece.replace(SPACE, " ").encode())
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(x) for x in shown])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids: pieces joined, bytes as UTF-8 (U+FFFD where they are none), the first space dropped."""
        sizes = self.shown_at[ids + 1] - self.shown_at[ids]
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        raw = self.shown[np.repeat(self.shown_at[ids] - (ends - sizes), sizes) + np.arange(n)].tobytes()
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(at[:-1], at[1:], strict=True)]


class Pieces(Decoder):
    """Encodes and decodes as the sentencepiece library does for models with the identity normaliser and byte fallback."""

    def __init__(self, path: str, unigram: bool = False):
        import sentencepiece

        super().__init__(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unigram = unigram
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.score = np.array([model.get_score(i) for i in range(n)])
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte = np.zeros(256, np.int32)
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
        self.pieces = {piece: i for i, piece in enumerate(self.text) if not special[i]}
        self.longest = max(map(len, self.pieces))
        self._whole = np.full(n, -1, np.int8)
        # characters of longer pieces are numbered; pairs of them that stand together in a piece hold a text together
        chars = sorted({c for p in self.pieces if len(p) > 1 for c in p})
        if any(c not in self.pieces for c in chars):
            raise ValueError("a character of a piece is no piece itself")
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_chars = len(chars) + 1
        self.joined = np.zeros(self.n_chars * self.n_chars, dtype=bool)
        for p in self.pieces:
            if len(p) > 1:
                numbers = self.number[[ord(c) for c in p]].astype(np.int64)
                self.joined[numbers[:-1] * self.n_chars + numbers[1:]] = True
        # sorted keys of all pieces and of their beginnings
        keys: dict[int, int] = {}
        for p, i in self.pieces.items():
            v = _values(np.array([ord(c) for c in p]))
            for k, key in enumerate(np.cumsum(v * _powers(self.longest)[: len(p)]).tolist(), 1):
                if k == len(p):
                    keys[key] = i
                else:
                    keys.setdefault(key, -1)
        self.keys = np.array(sorted(keys), np.uint64)
        self.id_of = np.array([keys[k] for k in self.keys.tolist()], np.int32)
        self.pairs, self.fits = Memo(), np.zeros(1 << 14, dtype=bool)
        self._clear()

    def forget(self) -> None:
        """Give up what was learnt of words and pairs of pieces; a worker does so after each task, as it waits for others of any kind."""
        self.pairs, self.fits = Memo(8), np.zeros(1 << 4, dtype=bool)
        self.memo, self.ids, self.at, self.used = Memo(8), np.zeros(1 << 4, np.int32), np.zeros(1 << 4, np.int64), 0

    def _clear(self) -> None:
        self.memo, self.ids, self.at, self.used = Memo(), np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbours, the leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.pieces.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _follows(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may come after the other (-1: it comes first)."""
        out = np.zeros(len(piece), dtype=bool)
        first = last < 0
        for i in np.unique(piece[first][self._whole[piece[first]] < 0]).tolist():
            self._whole[i] = self.merge(self.text[i]) == [self.text[i]]
        out[first] = self._whole[piece[first]] == 1
        rest = np.flatnonzero(~first)
        key = mix(last[rest].astype(np.uint64) << np.uint64(32) | piece[rest].astype(np.uint64))
        entry = self.pairs.find(key)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            if self.pairs.n > MEMO:
                self.pairs = Memo()
                return self._follows(last, piece)
            new, at = np.unique(key[missing], return_index=True)
            at, n = rest[missing[at]], self.pairs.n
            while len(self.fits) < n + len(new):
                self.fits = np.concatenate([self.fits, np.zeros_like(self.fits)])
            self.fits[n : n + len(new)] = [self.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]] for a, b in zip(last[at].tolist(), piece[at].tolist(), strict=True)]
            self.pairs.add(new)
            entry[missing] = self.pairs.find(key[missing])
        out[rest] = self.fits[entry]
        return out

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each word) for words of equal length, given as rows of code points."""
        n, length = words.shape
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last, back = np.full((length + 1, n), -1, np.int32), np.zeros((length + 1, n), np.int32)
        values, power = _values(words.T), _powers(self.longest)
        for j in range(length):
            rows, key = np.flatnonzero(best[j] > -np.inf), np.uint64(0)
            for size in range(1, min(self.longest, length - j) + 1):
                key = key + values[j + size - 1, rows] * power[size - 1]
                where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                alive = self.keys[where] == key
                rows, key, piece = rows[alive], key[alive], self.id_of[where[alive]]
                if not len(rows):
                    break
                ends = np.flatnonzero(piece >= 0)
                who, p = rows[ends], piece[ends]
                score = best[j, who] + (self.score[p] if self.unigram else 1.0)
                if not self.unigram:
                    score[~self._follows(last[j, who], p)] = -np.inf
                better = score > best[j + size, who]
                who = who[better]
                best[j + size, who], last[j + size, who], back[j + size, who] = score[better], p[better], size
        # walk back from the ends
        taken, at, alive = [], np.full(n, length), np.arange(n)
        while len(alive):
            taken.append((alive, last[at[alive], alive]))
            at[alive] -= back[at[alive], alive]
            alive = alive[at[alive] > 0]
        counts = np.bincount(np.concatenate([a for a, _ in taken]), minlength=n)
        ids, ends = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts)
        for step, (who, p) in enumerate(taken):
            ids[ends[who] - 1 - step] = p
        return ids, counts

    def _learn(self, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> None:
        order = np.argsort(lengths, kind="stable")
        hashes, starts, lengths = hashes[order], starts[order], lengths[order]
        for size in np.unique(lengths).tolist():
            mine = slice(np.searchsorted(lengths, size), np.searchsorted(lengths, size, "right"))
            words = code[starts[mine][:, None] + np.arange(size)]
            if size == 1:
                found = [[self.pieces[c]] if (c := chr(x)) in self.pieces else self.byte[list(c.encode())].tolist() for x in words[:, 0].tolist()]
                ids, counts = np.array([i for f in found for i in f], np.int32), np.array([len(f) for f in found])
            else:
                ids, counts = self.viterbi(words)
            n = self.memo.n
            while len(self.ids) < self.used + len(ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while len(self.at) < n + len(counts) + 1:
                self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.at[n + 1 : n + 1 + len(counts)] = self.used + np.cumsum(counts)
            self.used += len(ids)
            self.memo.add(hashes[mine])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))])
        code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        number = self.number[code].astype(np.int64)
        start = np.ones(len(code), dtype=bool)
        start[1:] = ~self.joined[number[:-1] * self.n_chars + number[1:]]
        start[first[:-1][first[:-1] < len(code)]] = True
        starts = np.flatnonzero(start)
        lengths = np.diff(np.append(starts, len(code)))
        inside = np.arange(len(code)) - np.repeat(starts, lengths)
        hashes = mix(np.add.reduceat(mix(_values(code) + (inside.astype(np.uint64) << np.uint64(33))), starts) + lengths.astype(np.uint64))
        if self.memo.n + len(hashes) > MEMO:
            self._clear()
        entry = self.memo.find(hashes)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            self._learn(new, starts[missing[at]], lengths[missing[at]], code)
            entry[missing] = self.memo.find(hashes[missing])
        counts = self.at[entry + 1] - self.at[entry]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.at[entry] - (ends - counts), counts) + np.arange(ends[-1])]
        total = np.concatenate([[0], ends])
        return ids, np.diff(total[np.searchsorted(starts, first)])


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


@cache
def pieces(path: str, unigram: bool = False) -> Pieces:
    return Pieces(path, unigram)


def _encoded(model: Pieces, column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, row after the last, their lists of ids), about CHUNK bytes of text at a time."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets, CHUNK):
        found, counts = model.encode([data[a:b].tobytes().decode() for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)])
        yield lo, hi, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found, pa.int32()), mask=column.slice(lo, hi - lo).is_null())


def _decoded(model: Decoder, column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, row after the last, their texts), about IDS ids at a time."""
    values = column.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(counts)])
    for lo, hi in chunks(at, IDS):
        missing = column.slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
        yield lo, hi, pa.array(model.decode(values[at[lo] : at[hi]], counts[lo:hi]), pa.string(), mask=missing)


def _with(batch: pa.RecordBatch, lo: int, hi: int, **new: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), *new.values()], [*kept, *new])


def _mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], **new: T.DataType) -> DataFrame:
    """``df`` with the columns that ``run`` puts after the others."""
    out = df.drop(*new)
    return df.mapInArrow(tidy(run), T.StructType([*out.schema.fields, *(T.StructField(k, t) for k, t in new.items())]))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", unigram: bool = False) -> DataFrame:
    """``docs`` with the piece ids of each whole text (array<int>), without begin or end ids.

    ``path`` is a sentencepiece model on every executor. Null stays null, the empty text has no ids; rows are encoded one by
    one, repeated ones alike; no shuffle. A column named as the new one is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, unigram)
        for batch in batches:
            for lo, hi, lists in _encoded(model, batch.column(text)):
                yield _with(batch, lo, hi, **{ids: lists})
        model.forget()

    return _mapped(docs, run, **{ids: T.ArrayType(T.IntegerType())})


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of each list of ids; null stays null, no ids give the empty text. A column named as the new one is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = decoder(path)
        for batch in batches:
            for lo, hi, texts in _decoded(model, batch.column(ids)):
                yield _with(batch, lo, hi, **{text: texts})

    return _mapped(rows, run, **{text: T.StringType()})


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: bool = True) -> DataFrame:
    """``encode``, and ``decode`` of its ids in the same pass: ids, decoded and round_trip, whether the text came back as it was (U+2581 aside, it does; null does).

    Without ``keep``, the decoded texts stay in the tasks. Columns named as the new ones are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for lo, hi, lists in _encoded(model, batch.column(text)):
                back = pa.concat_arrays([pa.array([], pa.string()), *(x for _, _, x in _decoded(model, lists))])
                same = pa.compute.equal(back, batch.column(text).slice(lo, hi - lo).cast(pa.string()))
                yield _with(batch, lo, hi, ids=lists, **({"decoded": back} if keep else {}), round_trip=pa.compute.fill_null(same, True))
        model.forget()

    return _mapped(docs, run, ids=T.ArrayType(T.IntegerType()), **({"decoded": T.StringType()} if keep else {}), round_trip=T.BooleanType())
