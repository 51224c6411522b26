"""Benchmark decontamination: a broadcast hash set of benchmark word windows against the words of every document."""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .hashing import ALNUM, ALNUM_LOWER, SMALL_CHUNK, Words, chunks, utf8
from .shared import tidy, written

#: Bytes of benchmark text held and broadcast at once, about; a larger benchmark is scanned for in several blocks, one after another.
BLOCK_BYTES = 8 << 20

NEW = ("n_words", "n_hit", "hit_spans", "hit_items")
_TYPES = (T.LongType(), T.LongType(), T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])), T.ArrayType(T.StringType()))


_ITEM = pa.schema([("item", pa.string()), ("words", pa.binary()), ("n", pa.int32()), ("hashes", pa.binary())])


def _prepared(window: int):
    """Of each item with words: its folded words with a space after each, the length of its windows and their hashes in order."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets, SMALL_CHUNK):
                words = Words(data, offsets, lo, hi, ALNUM)
                hashes, rows = words.hashes(), []
                for d in range(hi - lo):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    if n := min(window, b - a):
                        raw = words.data[words.starts[a] : words.ends[b - 1]].tobytes().translate(ALNUM_LOWER)
                        rows.append((batch.column("item")[lo + d].as_py(), b" ".join(raw.split()) + b" ", n, words.runs_of(hashes, d, n).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ITEM, strict=True)], schema=_ITEM)

    return prepare


class Windows:
    """Windows of a block of items: for each length in words the sorted hashes, a place of each one's words in ``text``, and the items that hold it."""

    def __init__(self, items: pa.Table):
        self.names = items["item"].to_pylist()
        self.text = b"".join(x.as_buffer().to_pybytes() for x in items["words"])
        ends = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        lengths, hashes = items["n"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in items["hashes"]]
        n_windows = np.array([len(x) for x in hashes], np.int64)
        n_words = n_windows + lengths - 1
        first = np.cumsum(n_words) - n_words
        self.by_length = {}
        for n in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == n)
            count = n_windows[mine]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            word, item = np.repeat(first[mine], count) + inside, np.repeat(mine, count).astype(np.int32)
            key = np.concatenate([hashes[i] for i in mine])
            order = np.lexsort((word, key))
            key, word, item = key[order], word[order], item[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            text = lambda i: self.text[starts[word[i]] : ends[word[i] + n - 1]]  # noqa: B023, E731
            group = np.flatnonzero(new)
            of_one = np.repeat(group, np.diff(np.append(group, len(key))))
            # chance hits: other words under the same hash become entries of their own
            for lo in sorted({int(of_one[i]) for i in np.flatnonzero(~new).tolist() if text(i) != text(of_one[i])}):
                hi = int(np.append(group, len(key))[np.searchsorted(group, lo) + 1])
                by_text = np.array(sorted(range(lo, hi), key=text))
                word[lo:hi], item[lo:hi] = word[by_text], item[by_text]
                new[lo + 1 : hi] = [text(i) != text(i - 1) for i in range(lo + 1, hi)]
            group = np.flatnonzero(new)
            known = key[group]
            bits = max(16, int(np.ceil(np.log2(len(known) * 32 + 1))))
            seen = np.zeros(1 << bits, dtype=bool)
            seen[known >> np.uint64(64 - bits)] = True
            self.by_length[n] = known, starts[word[group]], ends[word[group] + n - 1], np.append(group, len(key)), item, np.uint64(64 - bits), seen

    def find(self, words: Words) -> tuple[np.ndarray, dict[int, set]]:
        """(hit, items): whether each word is inside a window; by document, the items with a window there."""
        hit, items = np.zeros(len(words.starts), dtype=bool), defaultdict(set)
        hashes = words.hashes()
        for n, (known, text_start, text_end, first, item, shift, seen) in self.by_length.items():
            at, runs = words.runs(hashes, n)
            maybe = np.flatnonzero(seen[runs >> shift])
            where = np.searchsorted(known, runs[maybe])
            real = known[np.minimum(where, len(known) - 1)] == runs[maybe]
            for i, place in zip(at[maybe[real]].tolist(), where[real].tolist(), strict=True):
                raw = b" ".join(words.data[words.starts[i] : words.ends[i + n - 1]].tobytes().translate(ALNUM_LOWER).split())
                same = known[place]
                while place < len(known) and known[place] == same:
                    if self.text[text_start[place] : text_end[place]] == raw:
                        hit[i : i + n] = True
                        items[int(words.doc[i])].update(self.names[k] for k in item[first[place] : first[place + 1]].tolist() if self.names[k] is not None)
                    place += 1
        return hit, items


def _spans(words: Words, hit: np.ndarray, doc: int, base: int) -> list[dict]:
    """Byte ranges of the document's runs of hit words."""
    a, b = words.first[doc], words.first[doc + 1]
    edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
    return [{"start": int(words.starts[a + s]) - base, "end": int(words.ends[a + e - 1]) - base} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _scan(text: str, broadcast, follow: bool, cut: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = broadcast.value
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            n_words, n_hit, spans, items = [], [], [], []
            for lo, hi in chunks(offsets, SMALL_CHUNK):
                words = Words(data, offsets, lo, hi, ALNUM)
                hit, found = windows.find(words)
                n_words.append(words.counts)
                per_doc = np.bincount(words.doc[hit], minlength=hi - lo)
                n_hit.append(per_doc)
                for d in range(hi - lo):
                    spans.append(_spans(words, hit, d, int(offsets[lo + d] - offsets[lo])) if per_doc[d] else [])
                    items.append(sorted(found[d]) if d in found else [])
            n_words, n_hit = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (n_words, n_hit))
            raw = lambda k: data[offsets[k] : offsets[k + 1]].tobytes()
            if follow:
                for k, (s, i) in enumerate(zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist(), strict=True)):
                    if s:
                        spans[k], items[k] = _joined(s + spans[k]), sorted({*i, *items[k]})
                        n_hit[k] = sum(len(raw(k)[x["start"] : x["end"]].translate(ALNUM_LOWER).split()) for x in spans[k])
            kept = [c for c in batch.schema.names if c not in NEW]
            columns = [batch.column(c) for c in kept]
            if cut and any(spans):
                texts = columns[kept.index(text)].to_pylist()
                for k in (k for k, s in enumerate(spans) if s):
                    edges = [0, *(v for x in spans[k] for v in (x["start"], x["end"])), len(raw(k))]
                    texts[k] = b"".join(raw(k)[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
                columns[kept.index(text)] = pa.array(texts, batch.column(text).type)
            found = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *found], [*kept, *NEW])

    return scan


def _joined(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] < out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, cut: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside windows), hit_spans (byte ranges of ``text``), hit_items (sorted item
    ids, as strings) and contaminated (n_hit > 0 and ``share`` * n_hit >= n_words).

    Words are runs of digits, letters and non-ASCII, A-Z folded. A window is ``window`` consecutive words of an item; an
    item of fewer words is one window, an item without words none. Every hash hit is compared word by word.
    Null or empty texts have no words and no hits; repeated rows are each scanned; an item without id marks words but is
    not listed. Columns of ``docs`` with the names of the new ones are replaced. With ``cut``, the hit spans are removed
    from ``text``, while hit_spans still gives their places in the text as it was.
    Windows are hashed in tasks. The benchmark's size is measured first; beyond ``block_bytes`` of text it is dealt into
    blocks, and only one at a time goes through the driver and is broadcast: the documents are written between blocks and no
    shuffle is added. A hot source or repeated texts change nothing. Without documents or items the result has the same
    columns and no hits.
    """
    out = docs.drop(*NEW, "contaminated")
    schema = T.StructType([*out.schema.fields, *(T.StructField(n, t) for n, t in zip(NEW, _TYPES, strict=True))])
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-size // block_bytes))
    for k in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        block = spark.sparkContext.broadcast(Windows(mine.mapInArrow(tidy(_prepared(window)), from_arrow_schema(_ITEM)).toArrow()))
        last = k == n_blocks - 1
        out = out.mapInArrow(tidy(_scan(text, block, k > 0, cut and last)), schema)
        if not last:
            out = written(out, "benchmark-block")
            block.destroy()
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without contaminated documents, and with the hit spans cut from the others; columns stay as they are."""
    # columns of docs that are called as those of contamination() step aside
    aside = {c: f"_kept_{k}" for k, c in enumerate(docs.columns) if c in (*NEW, "contaminated")}
    found = contamination(docs.withColumnsRenamed(aside), benchmark, text, window=window, share=share, cut=True).where(~F.col("contaminated"))
    return found.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))
