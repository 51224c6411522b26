"""Token-id shards: each file holds the ids of a range of documents as a wavelet matrix, in ascending document order.

Files are rows of a Parquet table with one row a file, so they are written by Spark's committed writers to any store that
Spark reaches, and a lost task leaves no half-written shard.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import wavelet
from .encoder import CHUNK, encoder
from .hashing import chunks, utf8

#: Ids after which a shard is closed; a shard holds whole documents.
SHARD_TOKENS = 1 << 22
#: Stands for a null document id in a shard.
NO_ID = -(2**63)
#: Positions are looked up by cells of this many, so that a lookup is an equality join.
CELL = 1 << 22

_SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("base", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.binary())])


def _pack(path: str, end_id: int, limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, seq, base, n = [], 0, 0, 0, 0

        def closed() -> pa.RecordBatch:
            ids, docs, lengths = (np.concatenate([h[k] for h in held]) for k in range(3))
            shard = wavelet.build(ids, docs, np.cumsum(lengths))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, seq, base, len(docs), len(ids), shard), _SHARD.types, strict=True)], schema=_SHARD)

        tokens = encoder(path)
        kind = np.promote_types(tokens.kind, np.min_scalar_type(end_id))
        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else part
            docs = batch.column("doc").fill_null(NO_ID).to_numpy()
            data, offsets = utf8(batch.column("text"))
            for lo, hi in chunks(offsets, CHUNK):
                ids, lengths = tokens.encode(data, offsets, lo, hi)
                ids = np.insert(ids.astype(kind, copy=False), np.cumsum(lengths), end_id)
                held.append((ids, docs[lo:hi], lengths + 1))
                n += len(ids)
                if n >= limit:
                    yield closed()
                    held, seq, base, n = [], seq + 1, base + n, 0
        if held:
            yield closed()

    return pack


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of every text, each followed by ``end_id``, as wavelet shards to the new folder ``path``.

    ``tokenizer`` is a file of the tokenizers library, on every executor. Documents are dealt in ranges of (id, hash of
    text), so one id that many rows have is split as well, and sorted by id, then text; null ids come first. Null text is
    empty: only the end id. A range's shards are made one after another in bounded memory, and closed at ``shard_tokens``
    or the end of the document that passes it. An empty table gives no files. Extra columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc", "h").sortWithinPartitions("doc", "h", "text")
    packed = dealt.select("doc", "text", F.spark_partition_id().alias("part")).mapInArrow(_pack(tokenizer, end_id, shard_tokens), from_arrow_schema(_SHARD))
    packed.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """(start, n_docs, n_tokens, shard): the files at ``path``; start is the number of ids in all files before."""
    files = spark.read.schema(from_arrow_schema(_SHARD)).parquet(path)
    # a row for each task that wrote: their number is that of the write's partitions
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = parts.select("part", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return files.join(F.broadcast(before), "part").select((F.col("before") + F.col("base")).alias("start"), "n_docs", "n_tokens", "shard")


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, raw in zip(batch.column("start").to_pylist(), batch.column("shard"), strict=True):
            shard = wavelet.WaveletMatrix(raw.as_buffer().to_pybytes())
            ids = shard.decode().astype("<u4")
            docs, starts, ends = shard.documents()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(starts + start), pa.array(ends - starts), pa.array(crc, pa.int64())], schema=_DOCS)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, from their decoded ids."""
    return shards(spark, path).select("start", "shard").mapInArrow(_digest, from_arrow_schema(_DOCS))


def token_occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(position, doc_id): every place of ``token`` in the files, counted over all documents; found by select, not by decoding."""
    kind = pa.schema([("position", pa.int64()), ("doc_id", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column("start").to_pylist(), batch.column("shard"), strict=True):
                shard = wavelet.WaveletMatrix(raw.as_buffer().to_pybytes())
                at = shard.occurrences(token)
                docs, _, ends = shard.documents()
                found = docs[np.searchsorted(ends, at, "right")] if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at + start), pa.array(found, pa.int64(), mask=found == NO_ID)], schema=kind)

    return shards(spark, path).select("start", "shard").mapInArrow(find, from_arrow_schema(kind))


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) for each row of ``positions`` (column position) that lies in the files; read by rank, not by decoding."""
    kind = pa.schema([("position", pa.int64()), ("token", pa.int64())])
    files = shards(spark, path)
    cell = lambda x: F.floor(x / F.lit(CELL)).cast("long")
    spans = files.select("start", "n_tokens", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("n_tokens") - 1))).alias("cell"))
    asked = positions.select(F.col("position").cast("long"), cell(F.col("position")).alias("cell"))
    of_file = asked.join(spans, "cell").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens")))
    blocks = of_file.groupBy("start", "cell", (F.col("position") % 64).alias("k")).agg(F.collect_list("position").alias("positions"))
    grouped = blocks.join(files.select("start", "shard"), "start").select("start", "positions", "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, at, raw in zip(batch.column("start").to_pylist(), batch.column("positions"), batch.column("shard"), strict=True):
                places = np.array(at.as_py(), np.int64)
                found = wavelet.WaveletMatrix(raw.as_buffer().to_pybytes()).access(places - start)
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(found)], schema=kind)

    return grouped.mapInArrow(read, from_arrow_schema(kind))


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(n): occurrences of ``token`` in all files, by rank."""
    kind = pa.schema([("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([wavelet.WaveletMatrix(x.as_buffer().to_pybytes()).count(token) for x in batch.column("shard")], pa.int64())], schema=kind)

    return shards(spark, path).select("shard").mapInArrow(count, from_arrow_schema(kind)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
