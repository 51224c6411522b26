"""Time-series files: (time, X, S, O2, CO2) rows read under fixed rules, with errors and warnings as rows beside them."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardwright.functions.text import SPACES, leading_number, let, squash

#: Data rows read of one file, and fewest accepted ones. Fixed values.
MOST_ROWS, LEAST_ROWS = 10_000, 5
#: Header names of each column, in order of preference of place.
HEADERS = {"t": ("time", "t"), "X": ("x",), "S": ("s",), "O2": ("o2", "do"), "CO2": ("co2",)}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_id"), F.col("value").alias("content"))


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, messages, status) of files (file_id, content).

    rows: file_id, row, t, X, S, O2, CO2 of accepted data rows. messages: file_id, row, severity, message. status: file_id,
    ok, n_rows. Blank lines and those that begin with # are dropped before rows are numbered, the first data row being 2.
    A row is rejected for too few cells, for a t, X or S that begins with no finite number, and for a time that does not
    exceed that of all rows accepted before it; negative X and S become 0 with a warning. Only the first 10 000 data rows
    are read. Fewer than 5 accepted rows, or any error, make a file not ok; accepted rows are returned all the same.
    """
    kept = F.filter(F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"), "\n"), is_kept)
    whole = files.select("file_id", kept.alias("lines")).select("file_id", F.size("lines").alias("n_lines"), places(F.try_element_at("lines", F.lit(1))).alias("places"), "lines")
    data = whole.select("file_id", "places", F.posexplode(F.slice("lines", 2, MOST_ROWS)).alias("at", "line"))
    return judged(whole.drop("lines"), data)


def is_kept(line: Column) -> Column:
    """Neither blank nor a comment."""
    return F.regexp_like(line, F.lit(f"^[{SPACES}]*[^{SPACES}#]"))


def places(header: Column) -> Column:
    """struct(_t, _X, _S, _O2, _CO2): from 1, the first column of each name in a header, null for none."""
    at = lambda h, n: F.nullif(F.array_position(h, n).cast("int"), F.lit(0))
    first = lambda h, names: F.least(*(at(h, n) for n in names)) if len(names) > 1 else at(h, names[0])
    return let(F.transform(F.split(header, ","), squash), lambda h: F.struct(*(first(h, names).alias(f"_{c}") for c, names in HEADERS.items())))


def judged(heads: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``parse`` returns, from heads (file_id, n_lines, places), n_lines counting all kept lines, and data (file_id, places, at, line), at counting data rows from 0 up to ``MOST_ROWS``.

    ``places`` are those of the file's header, worked out once a file.
    """
    placed = heads.where("n_lines >= 2").select("file_id", "n_lines", "places.*")
    absent = F.array_compact(F.array(*(F.when(F.col(f"_{c}").isNull(), F.lit(f"missing column {'time' if c == 't' else c}")) for c in ("t", "X", "S"))))
    complete = placed.where(F.size(absent) == 0)

    data = data.where("places._t IS NOT NULL AND places._X IS NOT NULL AND places._S IS NOT NULL").select("file_id", "at", "line", "places.*")
    cells = F.split("line", ",")
    cell = lambda c: F.when(F.col(f"_{c}") <= F.size(cells), leading_number(F.element_at(cells, F.col(f"_{c}"))))
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    read = data.withColumns({"row": F.col("at") + 2, "short": F.size(cells) < F.greatest("_t", "_X", "_S")} | {c: finite(F.when(F.col(f"_{c}").isNotNull(), cell(c))) for c in HEADERS})
    wrong = F.when(F.col("short"), "too few cells").when(F.col("t").isNull(), "time is no number").when(F.col("X").isNull(), "X is no number").when(F.col("S").isNull(), "S is no number")
    read = read.withColumn("wrong", wrong)
    # a rejected time is at most the greatest before it, so the running maximum over well-formed rows is the last accepted time
    before = Window.partitionBy("file_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    read = read.withColumn("last", F.max(F.when(F.col("wrong").isNull(), F.col("t"))).over(before))
    read = read.withColumn("wrong", F.coalesce("wrong", F.when(F.col("t") <= F.col("last"), "time does not increase")))
    good = read.where(F.col("wrong").isNull())
    rows = good.select("file_id", "row", "t", F.greatest("X", F.lit(0.0)).alias("X"), F.greatest("S", F.lit(0.0)).alias("S"), "O2", "CO2")

    # messages of a file, and those of a row, come from one pass over files and one over rows
    say = lambda cond, severity, text: F.when(cond, F.struct(F.lit(severity).alias("severity"), text.alias("message")))
    told = lambda df, row, found: df.select("file_id", row.cast("int").alias("row"), F.explode(F.array_compact(found)).alias("m")).select("file_id", "row", "m.*")
    counts = complete.select("file_id").join(rows.groupBy("file_id").agg(F.count("*").alias("n")), "file_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    right = F.col("wrong").isNull()
    of_files = heads.select("file_id", "n_lines", "places.*").join(counts, "file_id", "left")
    some = F.col("n_lines") >= 2
    of_files = told(of_files, F.lit(None), F.concat(
        F.array(say(~some, "error", F.lit("the file is empty or has no data rows"))),
        F.when(some, F.transform(absent, lambda m: F.struct(F.lit("error").alias("severity"), m.alias("message")))).otherwise(F.array().cast("array<struct<severity:string,message:string>>")),
        F.array(say(F.col("n").isNotNull() & (F.col("n_lines") - 1 > MOST_ROWS), "warning", F.lit(f"only the first {MOST_ROWS} rows are read")), say(F.col("n") < LEAST_ROWS, "error", F.lit(f"fewer than {LEAST_ROWS} valid rows"))),
    ))
    of_rows = told(read, F.col("row"), F.array(say(~right, "error", F.col("wrong")), *(say(right & (F.col(c) < 0), "warning", F.lit(f"negative {c} set to 0")) for c in ("X", "S"))))
    messages = of_files.unionByName(of_rows)
    failed = messages.where("severity = 'error'").select("file_id").distinct().withColumn("_failed", F.lit(True))
    status = heads.select("file_id").join(failed, "file_id", "left").join(counts, "file_id", "left").select("file_id", F.col("_failed").isNull().alias("ok"), F.coalesce("n", F.lit(0)).alias("n_rows"))
    return rows, messages, status


def first_rows(rows: DataFrame) -> DataFrame:
    """(file_id, X0, S0): the state at the first time."""
    return rows.groupBy("file_id").agg(F.min_by(F.struct("X", "S"), "t").alias("f")).select("file_id", F.col("f.X").alias("X0"), F.col("f.S").alias("S0"))


def decimated(rows: DataFrame, key: str, order: str, every: Column | int) -> DataFrame:
    """Every k-th row of a series and its last one."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(key))})
    return numbered.where((F.col("_i") % every == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")
