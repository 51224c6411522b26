"""Token counts from a finite-state transducer compiled from a byte-level BPE vocabulary with word ends.

The transducer reads a word's bytes, the last one marked, and each transition carries the change of the number of tokens.
A state stands for all beginnings of words after which the same can happen: for each place from which a longer token may
still be open, the node of the token trie reached from there, the token that ends there and the tokens emitted since.
A token may follow another iff no merge crosses their border before both are complete; so of the tokens that could end at
a place exactly one fits, and states and transitions are deterministic. Transitions are compiled when first needed.

Texts run in lockstep: the marked bytes of a batch are cut into equal chunks whatever they hold, and each chunk is a map from
the state it starts in to the state it ends in. After a word end in it the map is constant. The map of a chunk without one
is found for the states that the chunk before can end in, all chunks at once, until no new state turns up; those are few, as
different beginnings soon lead to the same state. The maps are composed by doubling (a parallel prefix scan), which gives
each chunk the state that it starts in; then the chunks' heads run from there, all at once. A single word as long as many
chunks is counted like that too.
"""

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import chunks, utf8
from .shared import tidy

#: Symbols a chunk holds, and bytes of text taken at a time.
STEPS, BATCH = 512, 1 << 20
#: States after which a worker compiles anew; bounds its memory.
MAX_STATES = 150_000
#: Transition values hold the next state above these bits and the change of the count, plus OFFSET, below.
_SHIFT, OFFSET = 6, 32
SPACE, LETTER, NUMBER, OTHER, ODD, UNKNOWN = range(6)
#: Letters that make a word of their own with an apostrophe before them. Fixed values of the tokenizer's split pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_symbols() -> list[str]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b if b in shown else 256 + n)
        n += b not in shown
    return out


class Transducer:
    """Counts tokens as the tokenizers library does for the vocabulary file ``path`` (BPE, byte level, word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        byte_of = {c: b for b, c in enumerate(_byte_symbols())}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = rank
            self.parts.setdefault(whole, (rank, left, right))

        def symbols(token: str) -> list[int]:
            end = token.endswith(suffix)
            out = [byte_of[c] for c in (token[: -len(suffix)] if end else token)]
            return [*out[:-1], out[-1] + 256 * end]

        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, t in vocab.items():
            node = 0
            for s in symbols(token):
                if s not in self.children[node]:
                    self.children[node][s] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][s]
            self.token_at[node] = t
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.clear()

    def clear(self) -> None:
        self.column = np.full(512, -1, np.int64)
        self.n_columns = 0
        self.table = np.full((1024, 128), -1, np.int32)
        start = ((0, -1, 0),)
        self.states, self.index = [start], {start: 0}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(token, rank of the merge that uses it up) along the left (1) or right (2) edge of its tree, from the bytes up."""
        out, used = [], float("inf")
        while True:
            out.append((token, used))
            if token not in self.parts:
                return out[::-1]
            used, token = self.parts[token][0], self.parts[token][side]

    def _first_crossing(self, a: int, b: int) -> tuple[float, bool] | None:
        """(rank, whether both are complete) of the first merge across the border of a and b, if there is one."""
        left, right = self._spine(a, 2), self._spine(b, 1)
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = left[i], right[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_used and rank <= y_used:
                return rank, i == len(left) - 1 and j == len(right) - 1
            if i == len(left) - 1 and j == len(right) - 1:
                return None
            if x_used <= y_used:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        if token not in self.parts:
            return True
        if token not in self._whole:
            rank, a, b = self.parts[token]
            self._whole[token] = self.whole(a) and self.whole(b) and self._first_crossing(a, b) == (rank, True)
        return self._whole[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: their joint text is encoded as the two."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            known = self._fits[a, b] = self._first_crossing(a, b) is None
        return known

    def _compile(self, state: int, symbol: int) -> int:
        places = self.states[state]
        opened, token, count = [], -1, 0
        for node, last, since in places:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            t = self.token_at[child]
            if t >= 0 and token < 0 and self.whole(t) and (last < 0 or self.fits(last, t)):
                token, count = t, 1 - since
            if self.children[child]:
                opened.append((child, last, since))
        if token < 0:
            raise ValueError("no token ends here")
        if symbol >= 256:
            return 0 << _SHIFT | count + OFFSET
        # since: tokens between the place and the end
        key = (*((child, last, since + count) for child, last, since in opened), (0, token, 0))
        n = self.index.get(key)
        if n is None:
            n = self.index[key] = len(self.states)
            self.states.append(key)
            if n >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return n << _SHIFT | count + OFFSET

    def _columns(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as columns of the table; those never seen get new ones."""
        new = np.flatnonzero((np.bincount(symbols, minlength=512) > 0) & (self.column < 0))
        for s in new.tolist():
            self.column[s] = self.n_columns
            self.n_columns += 1
        while self.n_columns > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], 1)
        self.symbol = np.zeros(self.n_columns, np.int64)
        seen = np.flatnonzero(self.column >= 0)
        self.symbol[self.column[seen]] = seen
        return self.column[symbols].astype(np.int32)

    def _step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        value = self.table[state, column]
        if (value < 0).any():
            missing = np.flatnonzero(value < 0)
            pairs = np.unique(state[missing].astype(np.int64) << 32 | column[missing])
            for pair in pairs.tolist():
                s, c = pair >> 32, pair & 0xFFFFFFFF
                done = self._compile(s, int(self.symbol[c]))
                self.table[s, c] = done
            value = self.table[state, column]
        return value

    def _run(self, by_step: np.ndarray, inside: np.ndarray, lane: np.ndarray, state: np.ndarray, upto: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """The states after the first ``upto`` symbols of chunks ``lane`` from ``state``; with ``out``, the changes are noted there."""
        state, order = state.copy(), np.argsort(-upto, kind="stable")
        longest = upto[order]
        for t in range(int(longest[0]) if len(longest) else 0):
            run = order[: np.searchsorted(-longest, -t)]
            run = run[inside[t, lane[run]]]
            if not len(run):
                continue
            value = self._step(state[run], by_step[t, lane[run]])
            state[run] = value >> _SHIFT
            if out is not None:
                out[t, lane[run]] = (value & (1 << _SHIFT) - 1) - OFFSET
        return state

    def _maps(self, by_step: np.ndarray, inside: np.ndarray, has_end: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, begin, end): chunk k maps state begin[i] to end[i] for i from first[k] to first[k + 1]; chunks with a word end have one entry, whatever they start in."""
        n = len(has_end)
        lane, begin, end = np.arange(n)[has_end], np.zeros(int(has_end.sum()), np.int64), last[has_end].astype(np.int64)
        known = np.zeros(0, np.int64)
        # a chunk without word end is tried from the start state and from all states that the chunk before may end in
        new_lane = np.flatnonzero(~has_end)
        new_state = np.zeros(len(new_lane), np.int64)
        after = np.flatnonzero(~has_end[1:] & has_end[:-1]) + 1
        new_lane, new_state = np.append(new_lane, after), np.append(new_state, last[after - 1])
        while len(new_lane):
            new = np.setdiff1d(new_lane << 32 | new_state, known)
            known = np.union1d(known, new)
            new_lane, new_state = new >> 32, new & 0xFFFFFFFF
            ends = self._run(by_step, inside, new_lane, new_state, np.full(len(new_lane), STEPS))
            lane, begin, end = np.append(lane, new_lane), np.append(begin, new_state), np.append(end, ends)
            onward = (new_lane + 1 < n) & ~has_end[np.minimum(new_lane + 1, n - 1)]
            new_lane, new_state = new_lane[onward] + 1, ends[onward]
            fresh = ~np.isin(new_lane << 32 | new_state, known)
            new_lane, new_state = new_lane[fresh], new_state[fresh]
        order = np.lexsort((begin, lane))
        return np.searchsorted(lane[order], np.arange(n + 1)), begin[order], end[order]

    def _starts(self, first: np.ndarray, begin: np.ndarray, end: np.ndarray, has_end: np.ndarray) -> np.ndarray:
        """The state that each chunk starts in: the chunks' maps composed from the left by doubling."""
        n, most = len(has_end), int(np.diff(first).max())
        lane = np.repeat(np.arange(n), np.diff(first))
        # each entry's place among those of the next chunk
        after = np.minimum(lane + 1, n - 1)
        to = np.zeros(len(lane), np.int64)
        open_next = ~has_end[after] & (lane + 1 < n)
        to[open_next] = np.searchsorted(lane << 32 | begin, after[open_next] << 32 | end[open_next]) - first[after[open_next]]
        composed = np.zeros((n, most), np.int64)
        composed[lane, np.arange(len(lane)) - first[lane]] = to
        step = 1
        while step < n:
            composed[step:] = np.take_along_axis(composed[step:], composed[:-step].copy(), 1)
            step *= 2
        # the first chunk starts in its entry for state 0, which is its first
        into = np.concatenate([[0], composed[:-1, 0]])
        return np.concatenate([[0], end[first[:-1] + into][:-1]])

    def emitted(self, symbols: np.ndarray) -> np.ndarray:
        """The change of the token count at each symbol; the first one starts a word."""
        if len(self.states) > MAX_STATES:
            self.clear()
        n = len(symbols)
        lanes = -(-n // STEPS)
        columns = self._columns(symbols)
        padded = np.zeros(lanes * STEPS, np.int32)
        padded[:n] = columns
        by_step = np.ascontiguousarray(padded.reshape(lanes, STEPS).T)
        end = np.zeros(lanes * STEPS, dtype=bool)
        end[:n] = symbols >= 256
        inside = np.ones(lanes * STEPS, dtype=bool)
        inside[n:] = False
        inside, end = inside.reshape(lanes, STEPS).T, end.reshape(lanes, STEPS).T
        has_end = end.any(0)
        head = np.where(has_end, end.argmax(0) + 1, STEPS)
        out = np.zeros((STEPS, lanes), np.int8)
        # the constant part of every chunk's map: from its first word end on
        last = np.zeros(lanes, np.int64)
        for t in range(STEPS):
            run = np.flatnonzero((head <= t) & inside[t])
            if len(run):
                value = self._step(last[run], by_step[t, run])
                last[run] = value >> _SHIFT
                out[t, run] = (value & (1 << _SHIFT) - 1) - OFFSET
        if has_end.all():
            starts = np.concatenate([[0], last[:-1]])
        else:
            starts = self._starts(*self._maps(by_step, inside, has_end, last), has_end)
        self._run(by_step, inside, np.arange(lanes), starts, head, out)
        return out.T.reshape(-1)[:n]

    def _class(self, c: str) -> int:
        if unicodedata.category(c) == "Cn":
            return ODD
        pieces = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text))
        if not pieces(c):
            return SPACE
        if self.library.normalizer.normalize_str(c) != _folded(c):
            return ODD
        return LETTER if pieces("a" + c) == 1 else OTHER if pieces("!" + c) == 1 else NUMBER

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        spans = np.arange(len(texts) + 1)
        if self.specials and any("<|" in t for t in texts):
            parts, spans = [], [0]
            for k, t in enumerate(texts):
                cut = self.specials.split(t)
                extra[k] = len(cut) - 1
                parts += cut
                spans.append(len(parts))
            texts, spans = parts, np.array(spans)
        odd = np.zeros(len(texts), dtype=bool)
        folded = [t.lower() if t.isascii() else _folded(t) for t in texts]
        lengths = np.fromiter(map(len, folded), np.int64, len(folded))
        first = np.concatenate([[0], np.cumsum(lengths)])
        code = np.frombuffer("".join(folded).encode("utf-32-le"), np.uint32)
        kind = self.classes[code]
        if (kind == UNKNOWN).any():
            for c in np.unique(code[kind == UNKNOWN]).tolist():
                self.classes[c] = self._class(chr(c))
            kind = self.classes[code]
        # characters that a folded text shows only after folding are tested as what they are there; raw ones too
        if (kind == ODD).any():
            odd[np.searchsorted(first, np.flatnonzero(kind == ODD), "right") - 1] = True
        total = np.zeros(len(texts), np.int64)
        if len(code):
            total = self._sum(code, kind, first)
        for k in np.flatnonzero(odd).tolist():
            total[k] = len(self.library.encode(texts[k], add_special_tokens=False).ids)
        total = np.concatenate([[0], np.cumsum(total)])
        return np.diff(total[spans]) + extra

    def _sum(self, code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(code)
        start = np.empty(n, dtype=bool)
        start[0] = True
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start[first[:-1][first[:-1] < n]] = True
        alone = np.flatnonzero((code == 39) & start)
        alone = alone[alone + 1 < n]
        alone = alone[start[alone + 1] & (kind[alone + 1] == LETTER)]
        text_end = first[np.searchsorted(first, alone, "right")]
        alone = alone[alone + 1 < text_end]
        if len(alone):
            run_ends = np.append(np.flatnonzero(start), n)
            stop = run_ends[np.searchsorted(run_ends, alone + 1, "right")]
            for letters in CONTRACTIONS:
                mine = alone[alone + len(letters) < stop]
                for k, c in enumerate(letters):
                    mine = mine[code[mine + 1 + k] == ord(c)]
                start[mine + 1] = False
                after = mine + 1 + len(letters)
                after = after[after < n]
                start[after] = True
        kept = (kind != SPACE) & (kind != ODD)
        if not kept.any():
            return np.zeros(len(first) - 1, np.int64)
        # a word ends before the next start, or before something dropped
        ends = np.empty(n, dtype=bool)
        ends[-1] = True
        ends[:-1] = start[1:] | ~kept[1:]
        code, ends = code[kept], ends[kept]
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        symbols = np.frombuffer(code.tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int64)
        symbols[np.cumsum(width)[ends] - 1] += 256
        changes = np.concatenate([[0], np.cumsum(self.emitted(symbols), dtype=np.int64)])
        at_char = np.concatenate([[0], np.cumsum(kept)])
        at_byte = np.concatenate([[0], np.cumsum(width)])
        return np.diff(changes[at_byte[at_char[first]]])


def _folded(text: str) -> str:
    """NFC and lower case, character by character (no final sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    ``path`` is a vocabulary file of the tokenizers library on every executor. Special tokens' strings inside texts count
    one each, as by default there. Null is the empty text: 0 bytes, 0 tokens. Rows are counted one by one, so order,
    repeated rows and hot sources do not matter, and nothing is shuffled. Texts with characters on which this machine's
    Unicode tables and the library disagree are counted by the library. Columns with the new names are replaced.
    """
    names = ("n_bytes", "n_tokens", "over_limit")
    out = docs.drop(*names)
    schema = T.StructType([*out.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            counts = [np.zeros(0, np.int64)]
            for lo, hi in chunks(offsets, BATCH):
                counts.append(machine.counts([data[a:b].tobytes().decode() for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)]))
            kept = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.diff(offsets), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], [*kept, "n_bytes", "n_tokens"])

    return out.mapInArrow(tidy(count), schema).withColumn("over_limit", F.col("n_tokens") > limit)
