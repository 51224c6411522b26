"""A corpus pipeline over the documents table, in five stages; belongs to the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.llm import line_dedup, ngram_join, pieces, toxicity
from cardwright.llm.decontaminate import decontaminate as without_benchmark
from cardwright.llm.shared import drop_table, shared_dir, small_batches, tables_dropped, written

#: No single SQL statement expresses the trained model and the encoder.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)  # whole texts go to Python and back, and an executor holds several batches of them
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; texts without words have the labels' base rate and stay."""
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out())
    score = "toxicity_score"
    scored = toxicity.score(docs, toxicity.train(docs, labels), name=score)
    return scored.where(F.col(score) < 0.5).select(docs.columns)


def boilerplate_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that more than 5 % of their source's documents have. Documents of such lines only are cut as well, except equal
    copies within a source, whose lines are repeated with them: the next stage keeps one of each."""
    return _recounted(line_dedup.drop_boilerplate(docs, spare_copies=True).select(docs.columns))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; of rows that repeat an id and a text, one.

    Rows without an id are never dropped.
    """
    linked = ngram_join.ngram_components(docs)
    gone = written(linked.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "near-copies")
    repeated = written(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated-ids")
    small = lambda ids: F.broadcast(ids) if ids.count() <= ngram_join.BROADCAST_IDS else ids
    kept = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    if not repeated.limit(1).count():
        return kept
    again = small(repeated)
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items, without the passages that some still share with one."""
    return _recounted(without_benchmark(docs, _table(spark, sf_dir, "benchmark"))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document beside its other columns, their number, and whether they decode to its text. Null texts have null ids, 0 of them;
    columns named ids, n_ids or round_trip are replaced; repeated rows are encoded alike."""
    small_batches(spark)
    found = pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=False)
    return found.withColumn("n_ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long")).drop("text")


STAGES = [("toxicity", toxic_out), ("line_dedup", boilerplate_out), ("ngram_join", near_copies_out), ("decontamination", benchmark_out), ("sentencepiece", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written once; a stage's input and own tables are deleted when its result is there."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        with tables_dropped(spark):
            done = stage(spark, docs, sf_dir)
            done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before:
            drop_table(spark, before)
        before = path
    return docs
