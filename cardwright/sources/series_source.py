"""Time-series files as a Spark data source: ``spark.read.format("series_csv")`` and ``spark.readStream``, parts of files as partitions.

A row is a line of a file with its place; ``parse`` numbers lines over all parts of a file and judges them by the rules of ``series_csv``. Tasks read through
``pyarrow.fs``, so paths are local ones (shared by all executors) or addresses of stores that it knows; for others there is ``series_csv.read_files``.
"""

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from cardwright.sources import series_csv

#: Bytes of a file that one task reads, bytes read at once, and bytes of a line that are kept.
PART_BYTES, BUFFER, LINE_BYTES = 32 << 20, 1 << 20, 1 << 20
#: Bytes that opening a file counts as when small files are put together.
FILE_COST = 256 << 10
SCHEMA = "file_id string, part long, place long, line string"


class Part(NamedTuple):
    """Lines that begin from ``start`` to before ``end``; ``root`` tells the store, ``path`` is the file's there."""

    root: str
    path: str
    start: int
    end: int

    def file_id(self) -> str:
        return (self.root.split("://")[0] if "://" in self.root else "file") + "://" + self.path


class Found(NamedTuple):
    root: str
    path: str
    size: int
    changed: int


class Task(InputPartition):
    """Parts that one task reads: one of a large file, or many small files."""

    def __init__(self, parts: list[Part]):
        self.parts = parts


def _store(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path else (stores.LocalFileSystem(), path)


def found_files(path: str) -> list[Found]:
    """Files at a path or, where it is a folder, below it; names that begin with a dot or underscore are skipped."""
    store, root = _store(path)
    info = store.get_file_info(root)
    if info.type == stores.FileType.NotFound:
        raise FileNotFoundError(path)
    all_infos = [info] if info.type == stores.FileType.File else store.get_file_info(stores.FileSelector(root, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(root) :].split("/") if x)
    return sorted(Found(path, i.path, i.size, i.mtime_ns) for i in all_infos if i.type == stores.FileType.File and not hidden(i.path))


def parts(files: list[Found], size: int) -> list[Part]:
    return [Part(f.root, f.path, start, min(f.size, start + size)) for f in files for start in range(0, max(f.size, 1), size)]


def tasks(files: list[Found], size: int) -> list[Task]:
    """Parts, each at most ``size`` bytes, put together as long as they are no more than that."""
    out, held, total = [], [], 0
    for part in parts(files, size):
        cost = part.end - part.start + FILE_COST
        if held and total + cost > size + FILE_COST:
            out.append(Task(held))
            held, total = [], 0
        held.append(part)
        total += cost
    return [*out, Task(held)] if held else out


def lines(part: Part) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the part. A line ends at a line feed or a carriage return, so between the two of a pair is an empty line, which is no row anyway."""
    with _store(part.root)[0].open_input_file(part.path) as file:
        at = max(part.start - 1, 0)  # a line begins after the end of another one, which may be the byte before the part
        file.seek(at)
        skip, held = part.start > 0, b""
        while block := file.read(BUFFER):
            pieces = re.split(rb"[\r\n]", held + block)
            for piece in pieces[:-1]:
                if not skip:
                    yield at, piece
                skip, at = False, at + len(piece) + 1
                if at >= part.end:
                    return
            held = pieces[-1]
            if len(held) > LINE_BYTES:  # the rest of a very long line is passed over
                if not skip:
                    yield at, held[:LINE_BYTES]
                at, held, skip = at + len(held), b"", True
        if held and not skip:
            yield at, held


def _rows(task: Task) -> Iterator[tuple]:
    for part in task.parts:
        if part.start == 0:
            yield part.file_id(), 0, -1, None  # that there is such a file, however empty
        for place, line in lines(part):
            if line.strip():
                yield part.file_id(), part.start, place, line.decode("utf-8", "replace")


class _Batch(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Task]:
        return tasks(found_files(self.path), self.size)

    def read(self, partition: Task) -> Iterator[tuple]:
        return _rows(partition)


class _Stream(DataSourceStreamReader):
    """Files in the order in which they appeared, known by the time of their last change; a file is read once, whole."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": max((f.changed for f in found_files(self.path)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Task]:
        return tasks([f for f in found_files(self.path) if start["until"] < f.changed <= end["until"]], self.size)

    def read(self, partition: Task) -> Iterator[tuple]:
        return _rows(partition)


class SeriesCsv(DataSource):
    """Options: ``path``, and ``part_bytes``, the bytes of a file that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "series_csv"

    def schema(self) -> str:
        return SCHEMA

    def _settings(self) -> tuple[str, int]:
        return self.options["path"], max(1, int(self.options.get("part_bytes", PART_BYTES)))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._settings())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._settings())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SeriesCsv)


def read(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(file_id, part, place, line): lines that are not blank, with the part of the file and the byte where they begin; a file's first row has place -1 and no line."""
    register(spark)
    return spark.read.format("series_csv").option("part_bytes", part_bytes).load(path)


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, messages, status) as of ``series_csv.parse``, from lines as ``read`` gives them.

    Lines are numbered within each part, and parts by the numbers of lines before them; only the first 10 000 data lines of a file meet in one window.
    """
    kept = lines.where(F.col("line").isNotNull() & series_csv.is_kept(F.col("line")))
    counts = kept.groupBy("file_id", "part").agg(F.count("*").alias("some"))
    whole = Window.partitionBy("file_id")
    before = F.coalesce(F.sum("some").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("file_id", "part", before.alias("before"), F.sum("some").over(whole).alias("n_lines"))
    place = F.row_number().over(Window.partitionBy("file_id", "part").orderBy("place")) - 1
    first = kept.withColumn("in_part", place).where(F.col("in_part") <= series_csv.MOST_ROWS)
    numbered = first.join(shifts, ["file_id", "part"]).withColumn("at", (F.col("before") + F.col("in_part") - 1).cast("int")).where(F.col("at") < series_csv.MOST_ROWS)
    header = numbered.where("at = -1").select("file_id", series_csv.places(F.col("line")).alias("places"))
    files = lines.where("place = -1").select("file_id").join(shifts.groupBy("file_id").agg(F.max("n_lines").alias("n_lines")), "file_id", "left")
    heads = files.join(header, "file_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    data = numbered.where("at >= 0").join(header, "file_id").select("file_id", "places", "at", "line")
    return series_csv.judged(heads, data)


def follow(spark: SparkSession, path: str, handle: Callable[[DataFrame, DataFrame, DataFrame], None], checkpoint: str, part_bytes: int = PART_BYTES) -> StreamingQuery:
    """A stream of new files: ``handle`` gets the (rows, messages, status) of each batch of them. A batch may be handled again after a failure."""
    register(spark)
    stream = spark.readStream.format("series_csv").option("path", path).option("part_bytes", part_bytes).load()

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()  # the three tables read it
        try:
            handle(*parse(batch))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
