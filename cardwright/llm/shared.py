"""Folder for tables that jobs write between stages, and helpers around it."""

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that jobs hand to Python at a time where whole texts go both ways; an executor holds several such batches.
ROWS_AT_ONCE = 1_000

_own: list[str] = []
_made: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Only where that is unset and Spark is one local process (tests), under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: executors and the driver need a folder that all of them can read")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="cardwright-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    Later plans start from files that every executor can read, so a lost executor costs no earlier stage. Within
    ``tables_dropped`` the table goes at the end of the block, unless it is to be kept.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if _made and not keep:
        _made[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def tables_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes within the block are deleted at its end; what leaves the block is written with ``keep``."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            drop_table(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, n: int = ROWS_AT_ONCE) -> None:
    """From now on jobs of the session hand at most ``n`` rows at a time to Python; a smaller setting stays."""
    before = int(spark.conf.get(_ROWS))
    spark.conf.set(_ROWS, str(min(n, before) if before > 0 else n))


@contextmanager
def rows_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """``small_batches`` within the block; the session's own setting comes back after it."""
    before = spark.conf.get(_ROWS)
    small_batches(spark, n)
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives the memory that its allocators still hold back to the system: workers wait for later tasks, also for those of other operators."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return wrapped
