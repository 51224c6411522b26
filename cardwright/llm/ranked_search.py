"""Ranked lexical search of many items at once: term sets that items share are summed once for each document.

Items are sequences of distinct terms in one order, terms asked for by the same items next to each other. Neighbours that
several items have in common become a node, again and again, so the items form a graph whose nodes are shared term
sets. A task accumulates the terms of its documents, then every shared node once (the sum of its two parts), and items
from their nodes. Scores are integers, so any order of adding gives the same score.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import ALNUM, SMALL_CHUNK, Words, chunks, utf8
from .shared import ROWS_AT_ONCE, free_name, rows_at_once, tidy, written

#: Bytes of item text whose terms are broadcast at once, about; more items are ranked in several blocks, one after another.
BLOCK_BYTES = 4 << 20
#: Accumulators (nodes times documents) that a task holds at once, and candidates before they are cut to the best of each item.
HELD, CANDIDATES = 2_000_000, 400_000
#: What a word is, for SQL functions; ``hashing.ALNUM`` is the same for bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_POSTINGS = "doc_id long, n long, terms binary, tf binary"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Graph:
    """The query graph of a block: ``terms``, nodes by rounds (each a sum of two earlier ones) and the nodes of each item."""

    def __init__(self, names: list, terms: list[list[str]]):
        self.names = names
        self.terms = sorted({t for x in terms for t in x})
        number = {t: i for i, t in enumerate(self.terms)}
        lengths = np.array([len(x) for x in terms], np.int64)
        flat = np.array([number[t] for x in terms for t in x], np.int64)
        item = np.repeat(np.arange(len(terms)), lengths)
        asked = np.bincount(flat, minlength=len(self.terms))
        keys = np.random.default_rng(1).integers(0, 2**63, max(len(terms), 1), dtype=np.uint64)
        by_items = np.zeros(len(self.terms), np.uint64)  # equal where the same items ask for both terms
        np.bitwise_xor.at(by_items, flat, keys[item])
        order = np.lexsort((flat, by_items[flat], -asked[flat], item))
        self._merge(flat[order], item[order])

    def _merge(self, nodes: np.ndarray, item: np.ndarray) -> None:
        self.n_nodes, self.rounds = len(self.terms), []
        while len(nodes) > 1:
            key = nodes[:-1] * self.n_nodes + nodes[1:]
            pairs, which, count = np.unique(key, return_inverse=True, return_counts=True)
            inside = item[:-1] == item[1:]
            held = np.bincount(which[inside], minlength=len(pairs))
            # the pair that most items share comes first; of overlapping pairs the first takes its nodes
            place = np.empty(len(pairs), np.int64)
            place[np.lexsort((pairs, held))] = np.arange(1, len(pairs) + 1)
            strength = np.where(inside & (held[which] > 1), place[which], 0)
            left, right = np.append(0, strength[:-1]), np.append(strength[1:], 0)
            taken = np.flatnonzero((strength > left) & (strength > right))
            if not len(taken):
                break
            new, number = np.unique(which[taken], return_inverse=True)
            self.rounds.append((self.n_nodes, pairs[new] // self.n_nodes, pairs[new] % self.n_nodes))
            nodes = nodes.copy()
            nodes[taken] = self.n_nodes + number
            self.n_nodes += len(new)
            keep = np.ones(len(nodes), dtype=bool)
            keep[taken + 1] = False
            nodes, item = nodes[keep], item[keep]
        self.parts, self.first = nodes, np.searchsorted(item, np.arange(len(self.names) + 1))

    def additions(self) -> int:
        """Additions a document: of nodes and of what remains of the items."""
        return sum(len(x) for _, x, _ in self.rounds) + len(self.parts) - int((np.diff(self.first) > 0).sum())

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Items x documents, from terms x documents."""
        held = np.empty((self.n_nodes, values.shape[1]), np.int64)
        held[: len(values)] = values
        for start, a, b in self.rounds:
            np.add(held[a], held[b], out=held[start : start + len(a)])
        out = np.zeros((len(self.names), values.shape[1]), np.int64)
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            out[some] = np.add.reduceat(held[self.parts], self.first[some])
        return out


class Vocabulary:
    """Terms found among words by hash, then compared byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        text, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends]).astype(np.int64)
        for self.seed in range(1, 100):  # until no two terms share a hash
            hashes = Words(text, offsets, 0, len(raw), ALNUM).hashes(self.seed)
            if len(np.unique(hashes)) == len(raw):
                break
        self.order = np.argsort(hashes)
        self.known, self.text, self.start, self.size = hashes[self.order], text, offsets[:-1], np.diff(offsets)
        bits = max(16, (len(raw) * 32).bit_length())
        self.shift, self.seen = np.uint64(64 - bits), np.zeros(1 << bits, dtype=bool)
        self.seen[self.known >> self.shift] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of the words that are terms."""
        if not len(self.known) or not len(words.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes(self.seed)
        word = np.flatnonzero(self.seen[hashes >> self.shift])
        place = np.minimum(np.searchsorted(self.known, hashes[word]), len(self.known) - 1)
        right = self.known[place] == hashes[word]
        word, term = word[right], self.order[place[right]]
        size = words.ends[word] - words.starts[word]
        right = size == self.size[term]
        word, term, size = word[right], term[right], size[right]
        if not len(word):
            return word, term
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        equal = _FOLD[words.data[np.repeat(words.starts[word], size) + inside]] == self.text[np.repeat(self.start[term], size) + inside]
        right = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return word[right], term[right]


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first document, documents, their offsets), about SMALL_CHUNK bytes at a time; a longer document comes in stretches that end between words."""
    for lo, hi in chunks(offsets, SMALL_CHUNK):
        a, b = int(offsets[lo]), int(offsets[hi])
        while hi == lo + 1 and b - a > SMALL_CHUNK:
            end = a + SMALL_CHUNK
            while end < b:
                gaps = np.flatnonzero(~ALNUM[data[end : end + SMALL_CHUNK]])
                if len(gaps):
                    end += int(gaps[0])
                    break
                end = min(b, end + SMALL_CHUNK)
            yield lo, 1, np.array([a, end])
            a = end
        yield lo, hi - lo, np.append(a, offsets[lo + 1 : hi + 1]) if hi == lo + 1 else offsets[lo : hi + 1]


def _posted(broadcast):
    """Of each document with words: their number, its terms in order and how often each occurs."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = broadcast.value
        size = max(1, len(vocabulary.known))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n = np.zeros(len(batch), np.int64)
            keys, counts = [], []
            for lo, many, at in _stretches(data, offsets):
                words = Words(data, at, 0, many, ALNUM)
                n[lo : lo + many] += words.counts
                word, term = vocabulary.find(words)
                key, count = np.unique((words.doc[word] + lo) * size + term, return_counts=True)
                keys.append(key)
                counts.append(count)
            keys, counts = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
            key, which = np.unique(keys, return_inverse=True)
            tf = np.bincount(which, counts, len(key)).astype(np.int32) if len(key) else np.zeros(0, np.int32)
            term, at = (key % size).astype(np.int32), np.searchsorted(key // size, np.arange(len(batch) + 1))
            some = np.flatnonzero(n)
            pick = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() for i in some.tolist()], pa.binary())  # noqa: B023, E731
            ids = batch.column("doc_id").take(pa.array(some))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[some]), pick(term), pick(tf)], ["doc_id", "n", "terms", "tf"])

    return posted


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of int32 values kept as bytes."""
    data, offsets = utf8(column)
    return data[offsets[0] : offsets[-1]].view(np.int32) if offsets[-1] > offsets[0] else np.zeros(0, np.int32), (offsets - offsets[0]) // 4


def _counted(n_terms: int):
    """How many documents of the task hold each term; under -1 documents with words, under -2 all their words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, words = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(_joined(batch.column("terms"))[0], minlength=n_terms)
            docs, words = docs + len(batch), words + int(batch.column("n").to_numpy().sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [docs, words]))], ["term", "n"])

    return counted


def _best(item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each item: greatest score, null id, smallest id."""
    order = np.lexsort((ids, ~null, -score, item))
    sorted_items = item[order]
    start = np.searchsorted(sorted_items, sorted_items)
    return order[np.arange(len(order)) - start < k]


def _ranked(broadcast, n_docs: int, n_words: int, k: int, name_type: pa.DataType):
    """The k best documents of the task for each item."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weight = broadcast.value
        n_items, n_terms, at_once = len(graph.names), len(graph.terms), max(1, HELD // max(1, graph.n_nodes))
        floor = np.ones(n_items, np.int64)  # what a score must reach
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype=bool))]
        size = 0

        def cut() -> None:
            nonlocal held, size
            item, score, ids, null = (np.concatenate(x) for x in zip(*held, strict=True))
            best = _best(item, score, ids, null, k)
            held, size = [(item[best], score[best], ids[best], null[best])], len(best)
            full = np.bincount(item[best], minlength=n_items) == k
            least = np.full(n_items, np.iinfo(np.int64).max)
            np.minimum.at(least, item[best], score[best])
            floor[full] = least[full]

        for batch in batches:
            terms, at = _joined(batch.column("terms"))
            tf = _joined(batch.column("tf"))[0].astype(np.int64)
            length = 50 + 50 * batch.column("n").to_numpy() * n_docs // max(n_words, 1)
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            for lo in range(0, len(batch), at_once):
                hi = min(len(batch), lo + at_once)
                mine, doc = slice(at[lo], at[hi]), np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                values = np.zeros((n_terms, hi - lo), np.int64)
                values[terms[mine], doc] = weight[terms[mine]] * (1_000_000_000 * tf[mine] // (1000 * tf[mine] + 20 * length[lo + doc]))
                score = graph.scores(values)
                item, where = np.nonzero(score >= floor[:, None])
                held.append((item, score[item, where], ids[lo + where], null[lo + where]))
                size += len(item)
                if size > max(CANDIDATES, 4 * k * n_items):
                    cut()
        cut()
        item, score, ids, null = held[0]
        names = pa.array(graph.names, name_type).take(pa.array(item))
        yield pa.RecordBatch.from_arrays([names, pa.array(ids, mask=null), pa.array(score)], ["item_id", "doc_id", "score"])

    return ranked


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, terms): the distinct terms of each item, sorted; only A-Z are lower-cased."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(TERM), 0)
    terms = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item_id"), F.explode(words).alias("term"))
    return terms.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def search(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", doc: str = "doc_id", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score (integers): the ``k`` documents with the highest score above 0 for each item.

    A term is a run of ASCII letters, digits and whatever is not ASCII, A-Z lower-cased. With N documents that hold a term, L
    terms of theirs in all, n terms of a document, df documents that hold a term, tf its occurrences: the weight is
    floor(1000 ln((2N+2)/(2df+1))), m is 50 + 50nN div L, and a score sums weight * (10^9 tf div (1000 tf + 20 m)) over an
    item's distinct terms. Equal scores go by ascending document id, null first.

    Null or empty texts hold no term and are no documents; every row is a document, so a repeated row is ranked twice. Rows of
    items that share an id are one item; items without id or terms, or without a document that scores, give no rows. Without
    documents or items the result is empty. Further columns of either table, however named, are not read.

    A document's terms stay in its task: each task keeps the best ``k`` of each item, and only these are shuffled, first to
    (item, a number from the document) and then to items. Items are dealt into blocks of about ``block_bytes`` of text, of
    which one at a time is broadcast; documents are read once a block.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    docs = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-size // block_bytes))
    out = None
    for block in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        asked = item_terms(mine).orderBy("item_id").toArrow()
        graph = Graph(asked["item_id"].to_pylist(), asked["terms"].to_pylist())
        vocabulary = spark.sparkContext.broadcast(Vocabulary(graph.terms))
        with rows_at_once(spark, ROWS_AT_ONCE):
            postings = written(docs.mapInArrow(tidy(_posted(vocabulary)), _POSTINGS), "postings")
        vocabulary.destroy()
        n_terms = len(graph.terms)
        counts = postings.select("n", "terms").mapInArrow(_counted(n_terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        counts = dict(zip(counts["term"].to_pylist(), counts["n"].to_pylist(), strict=True))
        n_docs, n_words = counts.get(-1, 0), counts.get(-2, 0)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(n_terms)], np.int64)
        shared = spark.sparkContext.broadcast((graph, weight))
        found = postings.mapInArrow(tidy(_ranked(shared, n_docs, n_words, k, asked.schema.field("item_id").type)), schema)
        out = found if out is None else out.unionByName(found)
    place = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    part, rank = free_name(out, "part"), F.row_number()
    dealt = out.withColumn(part, F.pmod(F.xxhash64("doc_id"), F.lit(16))).withColumn("rank", rank.over(Window.partitionBy("item_id", part).orderBy(*place))).where(F.col("rank") <= k)
    return dealt.withColumn("rank", rank.over(Window.partitionBy("item_id").orderBy(*place))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
