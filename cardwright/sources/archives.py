"""ZIP archives of generated files as a Spark sink that commits in two steps: ``df.write.format("card_zip").save(path)``.

Tasks write each archive under a name of their own in a pending folder; the driver moves those that tasks told of to their places once all tasks are done, and clears
the folder. A task that fails or runs twice leaves nothing in place, and a job that fails leaves the path as it was.
"""

import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field

from pyarrow import fs as stores
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PENDING = "_pending"
#: The date of all members, so that equal files make equal archives.
DATE = (1980, 1, 1, 0, 0, 0)


@dataclass
class Written(WriterCommitMessage):
    """(pending path, final name) of a task's archives."""

    archives: list[tuple[str, str]] = field(default_factory=list)


def _store(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path else (stores.LocalFileSystem(), path)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, folder: str, overwrite: bool):
        self.path, self.folder, self.overwrite, self.job = path, folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        """One archive after another, one file of it at a time; rows of an archive follow each other."""
        store, root = _store(self.path)
        pending, done, now = f"{root}/{PENDING}/{self.job}", Written(), None
        store.create_dir(pending, recursive=True)
        with ExitStack() as last:
            for row in iterator:
                if row["archive"] != now:
                    last.close()
                    now = row["archive"]
                    if now is None or "/" in now or now[:1] in ("", ".", "_"):
                        raise ValueError(f"{now!r} is no name for an archive")
                    path = f"{pending}/{uuid.uuid4().hex}"
                    file = last.enter_context(store.open_output_stream(path))
                    book = last.enter_context(zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED))
                    done.archives.append((path, f"{now}.zip"))
                member = zipfile.ZipInfo(f"{self.folder}/{row['filename']}" if self.folder else row["filename"], DATE)
                member.compress_type = zipfile.ZIP_DEFLATED
                book.writestr(member, (row["content"] or "").encode())
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        archives = [a for m in messages if m for a in m.archives]
        names = [name for _, name in archives]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one archive were dealt to several tasks")
        there = {i.base_name for i in store.get_file_info(stores.FileSelector(root))}
        if not self.overwrite and (both := there & set(names)):
            self.abort(messages)
            raise FileExistsError(f"{len(both)} archives are there already, {min(both)} among them")
        for pending, name in archives:
            store.move(pending, f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: stores.FileSystem, root: str) -> None:
        store.delete_dir(f"{root}/{PENDING}/{self.job}") if store.get_file_info(f"{root}/{PENDING}/{self.job}").type != stores.FileType.NotFound else None
        left = store.get_file_info(stores.FileSelector(f"{root}/{PENDING}", allow_not_found=True))
        if not left and store.get_file_info(f"{root}/{PENDING}").type != stores.FileType.NotFound:
            store.delete_dir(f"{root}/{PENDING}")


class CardZip(DataSource):
    """Options: ``path``, and ``folder``, the folder inside the archives. Rows: archive, filename, content."""

    @classmethod
    def name(cls) -> str:
        return "card_zip"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not {"archive", "filename", "content"} <= set(schema.fieldNames()):
            raise ValueError("archives are made of rows with archive, filename and content")
        return _Writer(self.options["path"], self.options.get("folder", ""), overwrite)


def write_archives(files: DataFrame, path: str, archive: str = "extraction_id", folder: str = "model_package", overwrite: bool = False) -> None:
    """An archive for each value of ``archive`` from rows (archive, filename, content): ``path``/<archive>.zip.

    All archives are written by tasks, none passes through the driver. With ``overwrite``, archives of the same names are replaced, others stay; without it they are an error.
    """
    spark = files.sparkSession
    spark.dataSource.register(CardZip)
    rows = files.select(F.col(archive).cast("string").alias("archive"), "filename", "content")
    dealt = rows.repartition("archive").sortWithinPartitions("archive", "filename")
    dealt.write.format("card_zip").option("folder", folder).mode("overwrite" if overwrite else "append").save(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, filename, content) of the archives in a folder, folders inside them left out of the names."""
    import pyarrow as pa

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(pa.BufferReader(raw.as_buffer())) as book:
                    for member in book.namelist():
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, member.split("/")[-1], book.read(member).decode())], ["archive", "filename", "content"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    name = F.regexp_extract("path", r"([^/]*)\.zip$", 1)
    return found.select(name.alias("name"), "content").mapInArrow(members, "archive string, filename string, content string")
