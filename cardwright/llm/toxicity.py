"""Toxicity: subword embeddings averaged over a text into a linear softmax, trained jointly with numpy.

A word is the mean of the vectors of its character n-grams (with its borders) and of itself, hashed into buckets; a text
is the mean of its words. A misspelt word still shares n-grams with those seen. As the softmax is linear in the text's
vector, training yields one number a bucket, and scoring sums numbers.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .hashing import ALNUM, SMALL_CHUNK, Memo, Words, chunks, mix, utf8
from .shared import tidy

#: Labelled texts of each class that the model is fitted on at most, by the order of a hash of their id.
SAMPLE = 2_000
NGRAMS, BUCKET_BITS, DIM = (3, 4, 5, 6), 18, 8
#: A text's mean vector is multiplied by this before the softmax, so that a rare word of a long text can weigh.
GAIN = 40.0
EPOCHS, BATCH, RATE, DECAY = 10, 128, 0.03, 1e-5
#: Both were tried on training rows only: fitted where crc32(id) mod 5 is 2 to 4, judged where it is 1; the README has the figures.
#: A bucket is learnt if its share of the words of toxic texts and that of the other texts differ by this factor, and by this
#: many standard deviations of chance; all others stay zero, as do those never seen, so common word parts add no noise.
LIFT, SIGNIFICANT = 2.0, 5.0
#: Words whose n-grams are held at a time while the model is fitted.
FITTED_AT_ONCE = 10_000
#: Words whose numbers a worker remembers.
MEMO = 500_000

_FACTORS = np.random.default_rng(5).integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words one after another, where each word's begin): the n-grams of ``<word>`` and the whole."""
    framed = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(framed)), lengths)
    left = starts[owner + 1] - np.arange(len(code))
    with np.errstate(over="ignore"):
        offset = np.arange(len(code), dtype=np.uint64) - starts[owner].astype(np.uint64)
        whole = mix(np.add.reduceat(mix(code + (offset << np.uint64(32))), starts[:-1])) if len(framed) else np.zeros(0, np.uint64)
        found, owners = [whole], [np.arange(len(framed))]
        for n in NGRAMS:
            at = np.flatnonzero(left >= n)
            total = np.full(len(at), n, np.uint64)
            for k in range(n):
                total += code[at + k] * _FACTORS[k]
            found.append(mix(total))
            owners.append(owner[at])
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(framed)))])
    return (found[order] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), first


@dataclass
class Model:
    """logit = bias + GAIN * (mean over the words of the mean over their buckets of ``weight``)."""

    weight: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        buckets, first = subwords(words)
        return np.add.reduceat(self.weight[buckets], first[:-1]) / np.diff(first) if words else np.zeros(0)


def fit(vocabulary: list[str], texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, odds: float, seed: int = 7) -> Model:
    """Train on texts given as distinct words (places in ``vocabulary``) and their counts. ``odds`` are those of the labels at large.

    Adam on minibatches; embeddings and softmax are learnt together, and the bias is moved from the sample's odds to
    ``odds``. Without texts of both classes the model gives everything the score that the odds imply.
    """
    if not len(texts) or toxic.all() or not toxic.any():
        return Model(np.zeros(1 << BUCKET_BITS), float(np.clip(np.log(max(odds, 1e-9)), -20, 20)))
    rng = np.random.default_rng(seed)
    in_class = np.zeros((2, len(vocabulary)))
    for (words, _), y in zip(texts, toxic, strict=True):
        in_class[int(y)][words] += 1
    zero, one = np.zeros((2, 1 << BUCKET_BITS))
    for lo in range(0, len(vocabulary), FITTED_AT_ONCE):
        buckets, first = subwords(vocabulary[lo : lo + FITTED_AT_ONCE])
        owner = np.repeat(np.arange(lo, lo + len(first) - 1), np.diff(first))
        zero += np.bincount(buckets, weights=in_class[0][owner], minlength=len(zero))
        one += np.bincount(buckets, weights=in_class[1][owner], minlength=len(one))
    share = one.sum() / max(one.sum() + zero.sum(), 1)
    expected = (one + zero) * share
    apart = np.abs(one - expected) >= SIGNIFICANT * np.sqrt(expected * (1 - share))
    lift = (one * (1 - share) + 1e-9) / (zero * share + 1e-9)
    used = np.flatnonzero((one + zero > 0) & apart & ((lift >= LIFT) | (lift <= 1 / LIFT)))
    place = np.full(1 << BUCKET_BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    full, sizes, learnt = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(vocabulary), FITTED_AT_ONCE):
        buckets, first = subwords(vocabulary[lo : lo + FITTED_AT_ONCE])
        kept = place[buckets] >= 0
        full.append(np.diff(first))
        sizes.append(np.bincount(np.repeat(np.arange(len(first) - 1), np.diff(first))[kept], minlength=len(first) - 1))
        learnt.append(place[buckets[kept]])
    full, sizes, buckets = np.concatenate(full), np.concatenate(sizes), np.concatenate(learnt)
    first = np.concatenate([[0], np.cumsum(sizes)])
    if not len(used):
        return Model(np.zeros(1 << BUCKET_BITS), float(np.log(odds)))
    vectors = np.zeros((len(used), DIM), np.float32)
    softmax = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, softmax, bias)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            docs = [d for d in order[k : k + BATCH] if len(texts[d][0])]
            if not docs:
                continue
            own, inverse = np.unique(np.concatenate([texts[d][0] for d in docs]), return_inverse=True)
            weight = np.concatenate([texts[d][1] / texts[d][1].sum() for d in docs]).astype(np.float32)
            rows = np.repeat(np.arange(len(docs)), [len(texts[d][0]) for d in docs])
            n = sizes[own]
            ends = np.cumsum(n)
            sub = buckets[np.repeat(first[own] - (ends - n), n) + np.arange(ends[-1])]
            word = np.repeat(np.arange(len(own)), n)
            of_all = np.stack([np.bincount(word, weights=vectors[sub, j], minlength=len(own)) for j in range(DIM)], 1)
            word_vectors = (of_all / full[own][:, None]).astype(np.float32)
            text = GAIN * np.add.reduceat(word_vectors[inverse] * weight[:, None], np.searchsorted(rows, np.arange(len(docs))))
            logits = text @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), toxic[docs].astype(np.int64)] -= 1
            p /= len(docs)
            back = GAIN * (p @ softmax.T)
            of_word = np.stack([np.bincount(inverse, weights=back[rows, j] * weight, minlength=len(own)) for j in range(DIM)], 1) / full[own][:, None]
            of_bucket = np.stack([np.bincount(sub, weights=of_word[word, j], minlength=len(used)) for j in range(DIM)], 1)
            step += 1
            for param, grad, (m, v) in zip((vectors, softmax, bias), (of_bucket + DECAY * vectors, text.T @ p, p.sum(0)), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    share = toxic.sum() / (len(toxic) - toxic.sum())
    weight = np.zeros(1 << BUCKET_BITS)
    weight[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(weight, float(bias[1] - bias[0] + np.log(odds / share)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and counts of each text."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        words, counts = [], []
        for lo, hi in chunks(offsets, SMALL_CHUNK):
            w = Words(data, offsets, lo, hi, ALNUM)
            raw, starts, ends = w.data.tobytes(), w.starts.tolist(), w.ends.tolist()
            for d in range(hi - lo):
                bag: dict[str, int] = {}
                for i in range(w.first[d], w.first[d + 1]):
                    word = raw[starts[i] : ends[i]].decode().lower()
                    bag[word] = bag.get(word, 0) + 1
                words.append(list(bag))
                counts.append(list(bag.values()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], ["key", "label", "words", "counts"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` texts of each class, those first by a hash of their id; the odds come from all labels.

    An id labelled several times counts as toxic if any of its labels is 1; null labels and null ids are not used. Of several
    texts of one id the first in order is used.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max(label).cast("int").alias("label"))
    n = known.agg(F.count_if(F.col("label") == 1).alias("one"), F.count_if(F.col("label") == 0).alias("zero")).first()
    there = known.join(docs.select(F.col(id_col).alias("key")), "key", "left_semi")
    picked = [there.where(F.col("label") == c).orderBy(F.xxhash64("key"), "key").limit(sample) for c in (0, 1)]
    rows = docs.select(F.col(id_col).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked[0].union(picked[1])), "key").select("key", "label", "text")
    kind = pa.schema([("key", to_arrow_type(rows.schema["key"].dataType)), ("label", pa.int32()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])
    rows = rows.groupBy("key", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    bags = rows.mapInArrow(tidy(_bags), from_arrow_schema(kind)).toArrow()
    words = bags["words"].combine_chunks().flatten().dictionary_encode()
    by_name = pa.compute.sort_indices(words.dictionary).to_numpy()
    ids = np.argsort(by_name).astype(np.int32)[words.indices.to_numpy()]
    counts = bags["counts"].combine_chunks().flatten().to_numpy()
    ends = np.cumsum(pa.compute.list_value_length(bags["counts"]).to_numpy())
    vocabulary = words.dictionary.take(pa.array(by_name)).to_pylist()
    names = [str(k) for k in bags["key"].to_pylist()]
    order = sorted(range(len(names)), key=names.__getitem__)
    texts = [(ids[a:b], counts[a:b]) for a, b in ((ends[k - 1] if k else 0, ends[k]) for k in order)]
    toxic = bags["label"].to_numpy().astype(bool)[order]
    return fit(vocabulary, texts, toxic, n["one"] / max(n["zero"], 1))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.memo, self.values = Memo(), np.zeros(1 << 14)

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        out = [np.zeros(0)]
        for lo, hi in chunks(offsets, SMALL_CHUNK):
            w = Words(data, offsets, lo, hi, ALNUM)
            if not len(w.starts):
                out.append(np.full(hi - lo, self.model.bias))
                continue
            hashes = w.hashes()
            if self.memo.n + len(hashes) > MEMO:
                self._clear()
            entry = self.memo.find(hashes)
            missing = np.flatnonzero(entry < 0)
            if len(missing):
                new, first = np.unique(hashes[missing], return_index=True)
                first, raw, n = missing[first], w.data.tobytes(), self.memo.n
                words = [raw[a:b].decode().lower() for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
                while len(self.values) < n + len(words):
                    self.values = np.concatenate([self.values, np.zeros_like(self.values)])
                self.values[n : n + len(words)] = self.model.words(words)
                self.memo.add(new)
                entry[missing] = self.memo.find(hashes[missing])
            # each text's words are added for themselves, so equal texts score alike wherever they stand
            some = np.flatnonzero(w.counts)
            sums = np.zeros(hi - lo)
            sums[some] = np.add.reduceat(self.values[entry], w.first[some])
            out.append(self.model.bias + GAIN * sums / np.maximum(w.counts, 1))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -500, 500)))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1. Null and empty texts, and texts without words, have the score of the bias alone.

    Each row is scored by itself from its text only; repeated rows score alike; no shuffle. A column named as the new one
    is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            kept = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scorer.scores(batch.column(text)))], [*kept, name])

    out = docs.drop(name)
    return docs.mapInArrow(tidy(run), T.StructType([*out.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether an id is kept from training: crc32 of its text mod 5 is 0; null for a null id, which no label can have either."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
