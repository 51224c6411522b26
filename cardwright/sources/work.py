"""A folder for files that jobs write and read again."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []

#: Rows of a bucket, about: what a task sorts or groups stays as small as this, however large a table is.
BUCKET_ROWS = 400_000


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which all executors share; where that is unset and Spark is one local process, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors and the driver need a folder that all of them can read")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="cardwright-files-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a folder of its own, read again: several tables that are made of it do not make it again."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join that never broadcasts it: its size is told from that of the files, which rows made by ``explode``, maps of a card's rows and well compressed columns outgrow many times."""
    return df.hint("merge")


def buckets(spark: SparkSession, rows: int) -> int:
    """Buckets for a table of so many rows: their number grows with the table, not their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def bucketed(df: DataFrame, n: int, key: str, name: str) -> DataFrame:
    """``df`` as a table of ``n`` buckets by ``key``, read again: groups and joins by the key need no exchange. Rows that are dealt by ``key`` to ``n`` tasks make a file a bucket."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, key).option("path", work_dir(spark, name)).saveAsTable(table)
    return spark.table(table)
