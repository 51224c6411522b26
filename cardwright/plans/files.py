"""Registered queries of sources and sinks: files that Spark makes of the tables' texts and rows, and reads back."""

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardwright.operators import extract
from cardwright.plans.catalogue import _t, query
from cardwright.sources import archives, bucketed, ingest, pdf, series_source
from cardwright.sources.work import work_dir, written

#: Lines of a page of the files that are made of documents.
PAGE_LINES = 12
#: Bytes after which files that were made go on to the next step.
BATCH_BYTES = 1 << 20


def _tasks(spark: SparkSession) -> int:
    """Tasks for rows that are few bytes but take time; as a number that is asked for, adaptive execution keeps it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _as_pdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A PDF of each text, PAGE_LINES lines a page."""
    for batch in batches:
        first, size, made = 0, 0, []
        for k, text in enumerate(batch.column("text")):
            lines = text.as_py().split("\n")
            made.append(pdf.document([lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)]))
            size += len(made[-1])
            if size > BATCH_BYTES or k + 1 == len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(made)), pa.array(made, pa.binary())], ["id", "data"])
                first, size, made = k + 1, 0, []


_LINES = f"""
SELECT doc_id, CAST(ceil(len(l) / {PAGE_LINES}.0) AS BIGINT) AS pages,
  list_transform(range(0, CAST(ceil(len(l) / {PAGE_LINES}.0) AS BIGINT)), lambda p: array_to_string(list_filter(l[p * {PAGE_LINES} + 1 : (p + 1) * {PAGE_LINES}], lambda x: x <> ''), chr(10))) AS texts
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"""
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""
WITH read AS (SELECT doc_id, pages, trim(array_to_string(texts, chr(10) || chr(10)), {_SPACES}) AS t FROM ({_LINES}))
SELECT doc_id AS id, CASE WHEN pages > 200 THEN 'too many pages' WHEN length(t) < 30 THEN 'too little text' END AS reason,
  CASE WHEN pages <= 200 AND length(t) >= 30 THEN sha256(t) END AS text_sha256, CASE WHEN pages <= 200 AND length(t) >= 30 THEN length(t) END AS chars,
  CASE WHEN pages <= 200 AND length(t) >= 30 THEN CASE WHEN pages <= 1 THEN length(t) WHEN length(t) // pages > 0 THEN length(t) - (length(t) // pages) * (pages - 1) ELSE length(t) END END AS last_page
FROM read""")
def pdf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All documents as PDF files and their texts as the reader finds them: pages, characters, and why a file is refused. Empty lines are not shown on a page."""
    docs = _t(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    files = docs.repartition(_tasks(spark), "id").mapInArrow(_as_pdf, "id long, data binary")  # a text takes far more time than bytes, so the input's own parts are too few
    rows = ingest.pdf_rows(files)
    return rows.select("id", "reason", F.sha2("text", 256).alias("text_sha256"), F.col("chars").cast("long").alias("chars"), F.element_at("page_chars", -1).cast("long").alias("last_page"))


@query("""
WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, n + 1 AS row, CAST(event_id AS DOUBLE) AS t, greatest(value - 5, 0) AS x, CASE WHEN event_id % 5 <> 0 THEN value END AS o2 FROM e WHERE event_id % 7 <> 0 AND n <= 10000""")
def series_source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a file of their own, with comments, bad lines and line ends of two kinds, read through the data source in parts."""
    k = F.col("event_id")
    line = F.concat_ws(",", k.cast("string"), F.when(k % 7 == 0, "none").otherwise((F.col("value") - 5).cast("string")), F.lit("1"), F.when(k % 5 == 0, "n/a").otherwise(F.col("value").cast("string")))
    line = F.concat(F.when(k % 3 == 0, "# a comment\n\n").otherwise(""), line, F.when(k % 2 == 0, "\r\n").otherwise("\n"))
    # dealt by a number of tasks, which adaptive execution keeps: the rows are few bytes, but each user's file takes its time
    dealt = _t(spark, d, "events").repartition(_tasks(spark), "user_id")
    body = dealt.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))), lambda x: x["line"]), "").alias("body"))
    path = work_dir(spark, "series")
    body.select("user_id", F.concat(F.lit("# made of events\n Time ,X,s,DO\n"), "body").alias("value")).write.partitionBy("user_id").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)  # tasks put their files in place, not the driver one after another
    lines = written(series_source.read(spark, path, part_bytes=4 << 20), "lines")  # files are listed and opened once, not for each table made of their lines
    rows = series_source.parse(lines)[0]
    return rows.select(F.regexp_extract("file_id", r"user_id=(\d+)/", 1).cast("long").alias("user_id"), F.col("row").cast("long").alias("row"), "t", F.col("X").alias("x"), F.col("O2").alias("o2"))


@query("""
WITH f AS (
  SELECT s_suppkey, 'README.md' AS filename, '# ' || s_name || chr(10) AS content FROM supplier
  UNION ALL SELECT l_suppkey, 'lines.csv', string_agg(l_orderkey || ',' || l_linenumber || ',' || l_returnflag, chr(10) ORDER BY l_orderkey, l_linenumber, l_returnflag) FROM lineitem GROUP BY 1)
SELECT CAST(s_suppkey AS VARCHAR) AS archive, filename, length(content) AS chars, sha256(content) AS sha256 FROM f""")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    """An archive a supplier, written by tasks, committed together and read back."""
    about = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("extraction_id"), F.lit("README.md").alias("filename"), F.concat(F.lit("# "), "s_name", F.lit("\n")).alias("content"))
    line = F.struct("l_orderkey", "l_linenumber", F.concat_ws(",", "l_orderkey", "l_linenumber", "l_returnflag").alias("line"))
    rows = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("extraction_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("content"))
    path = work_dir(spark, "archives")
    archives.write_archives(about.unionByName(rows.withColumn("filename", F.lit("lines.csv"))), path)
    return archives.read_archives(spark, path).select("archive", "filename", F.length("content").cast("long").alias("chars"), F.sha2("content", 256).alias("sha256"))


@query("""
WITH l AS (SELECT l_orderkey, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
p AS (
  SELECT l_orderkey, max(n) AS n, string_agg(CASE WHEN n % 3 <> 1 THEN 'x' || n END, ', ' ORDER BY n) AS states,
    string_agg('    "p' || n || '": ' || CASE WHEN n % 4 = 3 THEN '0.0' ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || CASE n % 4 WHEN 1 THEN '.5' ELSE '' END END || ',  # '
      || CASE WHEN l_returnflag = 'N' THEN '—' ELSE l_returnflag || '/h' END || CASE WHEN n % 4 = 3 THEN '; not a number: "unknown"' ELSE '' END, chr(10) ORDER BY n) AS entries
  FROM (SELECT l_orderkey, l_returnflag, l_quantity, n FROM l) GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 7 THEN '# No ODE stub: the provider says that none can be made.' || chr(10) ELSE
  '# ODE stub: complete the right-hand side below.' || chr(10) || '# States: ' || coalesce(states, 'none') || chr(10) || chr(10) || 'import numpy as np' || chr(10) || 'from scipy.integrate import solve_ivp' || chr(10) || chr(10)
  || 'P = {' || chr(10) || entries || chr(10) || '}' || chr(10) || chr(10) || chr(10) || 'def rhs(t, y, p):' || chr(10) || '    dydt = np.zeros_like(y)' || chr(10) || '    # TODO: equations of ' || coalesce(states, 'none') || chr(10)
  || '    return dydt' || chr(10) || chr(10) || chr(10) || 'def solve(y, span=(0.0, 100.0), points=200):' || chr(10) || '    return solve_ivp(rhs, span, y, args=(P,), t_eval=np.linspace(*span, points))' || chr(10) || chr(10) || chr(10)
  || 'if __name__ == "__main__":' || chr(10) || '    print(solve([' || CASE WHEN states IS NULL THEN '1.0' ELSE regexp_replace(states, 'x[0-9]+', '1.0', 'g') END || ']).y[:, -1])' || chr(10) END AS stub
FROM orders JOIN p ON o_orderkey = l_orderkey""")
def ode_stubs(spark: SparkSession, d: str) -> DataFrame:
    """The stub of each order's document: lines are parameters with numbers, others not, and every line but each third is a state too."""
    lines = _t(spark, d, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = lines.select("l_orderkey", place.alias("n"), F.floor("l_quantity").cast("string").alias("q"), "l_returnflag")
    n, role = F.col("n"), F.when(F.col("n") % 3 == 1, "output").otherwise("state")
    value = F.when(n % 4 == 3, F.lit("unknown")).when(n % 4 == 1, F.concat("q", F.lit(".5"))).when(n % 4 == 2, F.concat(F.lit(" "), "q", F.lit(" g")))
    parameter = F.struct(n.alias("n"), F.concat(F.lit("p"), n).alias("symbol"), F.coalesce(value, "q").alias("value"), F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", F.lit("/h"))).otherwise("").alias("unit"))
    both = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(parameter)).alias("parameters"), F.array_sort(F.collect_list(F.struct(n.alias("n"), F.concat(F.lit("x"), n).alias("symbol"), role.alias("role")))).alias("state_variables"))
    card = F.struct((F.col("l_orderkey") % 10 != 7).alias("can_generate_ode_template")).alias("model_card")
    docs = both.select(F.col("l_orderkey").alias("id"), F.struct("parameters", "state_variables", card).alias("doc"))
    return docs.select("id", extract.ode_stub(F.col("doc")).alias("stub"))


def _tables(spark: SparkSession, keys: dict[str, str]) -> bucketed.Tables:
    return bucketed.Tables(spark, work_dir(spark, "tables"), keys, prefix=f"t{uuid.uuid4().hex}")


def _half_done(tables: bucketed.Tables, rows: dict[str, DataFrame]) -> None:
    """An insert that fails after its first table."""
    name, df = next(iter(rows.items()))
    tables._append(name, df.withColumn(bucketed.BATCH, F.lit("lost")))


@query("""
SELECT o_orderkey AS id, o_custkey AS customer, count(l_orderkey) AS n_lines, coalesce(sum(l_linenumber), 0) AS places FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_orderkey % 4 <> 3
WHERE o_orderkey % 4 <> 3 GROUP BY 1, 2""")
def bucketed_cards(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their lines, inserted together in three batches; a fourth one fails on the way. Counted and joined by key without an exchange."""
    tables = _tables(spark, {"cards": "id", "lines": "id"})
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("place"))
    of = lambda k: {"cards": orders.where(F.col("id") % 4 == k), "lines": lines.where(F.col("id") % 4 == k)}
    for k in range(3):
        tables.insert(of(k))
    _half_done(tables, of(3))
    counts = tables.scan("lines").groupBy("id").agg(F.count("*").alias("n_lines"), F.sum("place").alias("places"))
    return tables.scan("cards").join(counts, "id", "left").select("id", "customer", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("places", F.lit(0)).alias("places"))


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer) OR (c_acctbal > 0 AND c_mktsegment IS NOT NULL AND c_nationkey = 3)")
def bucketed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A row by its key, and rows under several conditions, from a table of customers."""
    tables = _tables(spark, {"customers": "c_custkey"})
    customers = _t(spark, d, "customer")
    tables.insert({"customers": customers})
    last = customers.agg(F.max("c_custkey").alias("k")).first()["k"]
    some = tables.where("customers", F.col("c_acctbal") > 0, F.col("c_mktsegment").isNotNull(), F.col("c_nationkey") == 3)
    return tables.lookup("customers", last).union(some).distinct().select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
