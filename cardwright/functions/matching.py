"""Many words looked for in a text at once, by one automaton that reads each character once."""

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of all words of an automaton, about; more words make several, which go over the texts one after another.
BLOCK_CHARS = 4 << 20


class Automaton:
    """States of a trie of words with links to the longest suffix that is a state too; empty words are left out."""

    def __init__(self, words: list[str]):
        self.words = sorted({w for w in words if w})
        self.next: list[dict[str, int]] = [{}]
        self.word = [-1]  # the word that ends in a state
        for number, w in enumerate(self.words):
            at = 0
            for c in w:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(-1)
                at = self.next[at][c]
            self.word[at] = number
        self.link, self.shorter = [0] * len(self.next), [0] * len(self.next)  # shorter: the nearest suffix at which a word ends
        todo = deque(self.next[0].values())
        while todo:
            at = todo.popleft()
            for c, to in self.next[at].items():
                back = self.link[at]
                while back and c not in self.next[back]:
                    back = self.link[back]
                self.link[to] = back = self.next[back].get(c, 0)
                self.shorter[to] = back if self.word[back] >= 0 else self.shorter[back]
                todo.append(to)

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(word, end) of all occurrences, in order of their ends, longer words first."""
        at, follow = 0, self.next
        for end, c in enumerate(text, 1):
            while at and c not in follow[at]:
                at = self.link[at]
            at = follow[at].get(c, 0)
            hit = at if self.word[at] >= 0 else self.shorter[at]
            while hit:
                yield self.word[hit], end
                hit = self.shorter[hit]

    def counts(self, text: str) -> dict[str, int]:
        """How often each word occurs, counted from the left without overlaps of a word with itself."""
        free, out = {}, {}
        for word, end in self.places(text):
            if end - len(self.words[word]) >= free.get(word, 0):
                free[word] = end
                out[word] = out.get(word, 0) + 1
        return {self.words[w]: n for w, n in out.items()}

    def found(self, text: str) -> set[int]:
        return {word for word, _ in self.places(text)}


def _blocks(words: DataFrame, word: str, block_chars: int) -> Iterator[list[str]]:
    size = words.agg(F.coalesce(F.sum(F.length(word)), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // block_chars))
    for k in range(n):
        mine = words.where(F.pmod(F.xxhash64(word), F.lit(n)) == k) if n > 1 else words
        yield [r[0] for r in mine.select(word).collect()]


def found_words(texts: DataFrame, words: DataFrame, text: str = "text", word: str = "word", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(word): the words that some text contains, each once. Tasks tell each word once; null texts and empty words are left out."""
    out = None
    for block in _blocks(words, word, block_chars):
        automaton = texts.sparkSession.sparkContext.broadcast(Automaton(block))

        def find(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            machine, seen = automaton.value, set()
            for batch in batches:
                for t in batch.column(0):
                    if t.is_valid and len(seen) < len(machine.words):
                        seen |= machine.found(t.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([machine.words[k] for k in sorted(seen)], pa.string())], ["word"])

        found = texts.select(text).mapInArrow(find, "word string")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("word").alias(word)).distinct()


def word_counts(texts: DataFrame, words: DataFrame, text: str = "text", word: str = "word", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``texts`` with a row for each word in it, and n, its occurrences without overlaps; a text without any has no row. Columns of ``texts`` called as these two are replaced."""
    kept, out = [c for c in texts.columns if c not in (word, "n")], None
    for block in _blocks(words, word, block_chars):
        automaton = texts.sparkSession.sparkContext.broadcast(Automaton(block))

        def count(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, t in enumerate(batch.column(text)):
                    if t.is_valid and (found := automaton.value.counts(t.as_py())):
                        rows = [batch.column(c).take(pa.array([k] * len(found))) for c in kept]
                        yield pa.RecordBatch.from_arrays([*rows, pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], [*kept, word, "n"])

        fields = texts.select(kept).schema.add(word, "string").add("n", "long")
        found = texts.select(kept).mapInArrow(count, fields)
        out = found if out is None else out.unionByName(found)
    return out
