"""Plain-text and PDF sources: limits, page counts and diagnostics. PDFs are read by ``cardwright.sources.pdf`` or by a function that the caller gives."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.functions.text import let, trim_all
from cardwright.sources import pdf

#: Limits of sources. Fixed values.
PDF_BYTES, PDF_PAGES, LEAST_CHARS, RETRY_CHARS, TEXT_BYTES = 20 << 20, 200, 30, 120, 10 << 20

#: Characters after which texts that were read go on to the next step.
BATCH_CHARS = 1 << 20


def text_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of whole text files: (path, content); those over 10 MB are rejected."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    small = F.octet_length("content") <= TEXT_BYTES
    return rows.where(small), rows.where(~small).select("path", F.lit("the file is too large").alias("reason"), F.lit(413).alias("status_code"))


def decoded_pdf(c: Column | str) -> Column:
    """Bytes of base64, with or without the head of a data URL; null if it is none."""
    t = F.col(c) if isinstance(c, str) else c
    return F.try_to_binary(F.when(F.contains(t, F.lit(",")), F.regexp_extract(t, "(?s)^[^,]*,(.*)$", 1)).otherwise(t), F.lit("base64"))


def page_texts(text: Column | str, pages: Column | int) -> Column:
    """Texts by page: parted at form feeds or three line ends; if that does not give as many as there are pages, parted evenly, the rest on the last."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.lit(pages) if isinstance(pages, int) else pages
    parts = F.split(t, "\f|\n\n\n")
    size = F.floor(F.length(t) / n).cast("int")
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(t, k * size + 1, F.when(k == n - 1, F.length(t)).otherwise(size)))
    return F.when(F.size(parts) == n, parts).otherwise(even)


def page_chars(text: Column | str, pages: Column | int) -> Column:
    return F.transform(page_texts(text, pages), lambda x: F.length(x))


def word_count(c: Column | str) -> Column:
    t = F.col(c) if isinstance(c, str) else c
    return F.size(F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda x: x != ""))


def page_char_counts(text: Column | str, pages: Column | int) -> Column:
    """Characters by page: of the parts between form feeds or two blank lines, trimmed, where there are at least as many as pages; else even shares, the rest on the last page."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.lit(pages) if isinstance(pages, int) else pages
    parts = F.split(t, r"\f|\n\s*\n\s*\n")
    share = F.floor(F.length(t) / n).cast("int")
    even = F.concat(F.array_repeat(share, n - 1), F.array(F.length(t) - share * (n - 1)))
    return F.when(n <= 1, F.array(F.length(t))).otherwise(let(parts, lambda p: F.when(F.size(p) >= n, F.transform(F.slice(p, 1, F.greatest(n, F.lit(0))), lambda x: F.length(trim_all(x)))).otherwise(even)))


Reader = Callable[[bytes], tuple[str, int]]


def read_pdf(raw: bytes) -> tuple[str, int]:
    """(text, pages) of a PDF: pages' texts with a blank line between them."""
    pages = pdf.page_texts(raw)
    return "\n\n".join(pages).strip(), len(pages)


_READ = "id {id}, early string, text string, pages long, retried boolean, error string"


def _reading(reader: Reader, retry: Reader | None):
    def read(raw: bytes) -> tuple[str | None, int | None, bool, str | None]:
        try:
            text, pages = reader(raw)
            if retry is None or len(text.strip()) >= RETRY_CHARS:
                return text, pages, False, None
            other, n = retry(raw)
            return (other, n, True, None) if len(other.strip()) > len(text.strip()) else (text, pages, False, None)
        except Exception as e:  # noqa: BLE001  a reader may fail in any way
            return None, None, False, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, found = 0, 0, []
            for k in range(len(batch)):  # a file may be large, and so may its text
                raw = batch.column("raw")[k].as_py()
                found.append((None, None, False, None) if raw is None else read(raw))
                held += len(found[-1][0] or "")
                if held > BATCH_CHARS or k + 1 == len(batch):
                    columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.string()), strict=True)]
                    asked = [batch.column(c).slice(first, len(found)) for c in ("id", "early")]
                    yield pa.RecordBatch.from_arrays([*asked, *columns], ["id", "early", "text", "pages", "retried", "error"])
                    first, held, found = k + 1, 0, []

    return run


def pdf_rows(files: DataFrame, reader: Reader = read_pdf, retry: Reader | None = None, data: str = "data") -> DataFrame:
    """``files`` read in one pass, a row a file: id, text, pages, chars, words, page_chars, extraction_mode and warnings of those accepted, reason and status_code of the others.

    ``reader`` gives (text, pages) of a file's bytes. Under 120 characters ``retry`` is asked and the longer text taken. ``data`` may also be a
    column of bytes, as ``pdf_files`` gives it. Tasks read one file after another; a file is at most 20 MB.
    """
    binary = files.schema[data].dataType.typeName() == "binary"
    # each file goes on as one row through steps that are not copied into every column that reads them
    raw = files.select("id", F.col(data).alias("raw")) if binary else files.select("id", F.explode(F.array(F.struct(decoded_pdf(data).alias("raw")))).alias("f")).select("id", "f.raw")
    size = F.coalesce(F.octet_length("raw"), F.lit(0))
    early = F.when(size == 0, "no PDF data").when(size > PDF_BYTES, "the file is too large")
    schema = _READ.format(id=files.schema["id"].dataType.simpleString())
    read = raw.select("id", early.alias("early"), F.when(early.isNull(), F.col("raw")).alias("raw")).mapInArrow(_reading(reader, retry), schema)
    text = trim_all("text")
    late = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("pages") > PDF_PAGES, "too many pages").when(F.length(text) < LEAST_CHARS, "too little text")
    code = F.when(F.col("early").isNull(), 422).when(F.col("early") == "no PDF data", 400).otherwise(413)
    read = read.select("id", F.explode(F.array(F.struct("pages", "retried", code.alias("code"), F.coalesce("early", late).alias("reason"), text.alias("text")))).alias("f")).select("id", "f.*")
    low = F.when((F.length("text") < RETRY_CHARS) | F.col("retried"), F.array(F.lit("little text on the first pass; read again with other settings"))).otherwise(F.array().cast("array<string>"))
    found = {
        "text": F.col("text"), "pages": F.col("pages"), "chars": F.length("text"), "words": word_count("text"), "page_chars": page_char_counts("text", F.col("pages").cast("int")),
        "extraction_mode": F.when(F.col("retried"), "normalized_whitespace").otherwise("default"), "warnings": low,
    }
    refused = F.col("reason").isNotNull()
    return read.select("id", *(F.when(~refused, c).alias(name) for name, c in found.items()), "reason", F.when(refused, F.col("code")).alias("status_code"))


def pdf_texts(files: DataFrame, reader: Reader = read_pdf, retry: Reader | None = None, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of base64 PDFs (id, data): the rows of ``pdf_rows`` with a text, and those with a reason. Each of the two reads the files; ``pdf_rows`` reads them once for both."""
    rows = pdf_rows(files, reader, retry, data)
    return rows.where(F.col("reason").isNull()).drop("reason", "status_code"), rows.where(F.col("reason").isNotNull()).select("id", "reason", "status_code")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, data, size) of PDF files in a folder, read by Spark: the path, the bytes (none beyond 20 MB, which are rejected by size) and the length."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return found.select(F.col("path").alias("id"), F.col("content").alias("data"), F.col("length").alias("size"))
