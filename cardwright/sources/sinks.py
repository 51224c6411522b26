"""Text and JSON forms of results: tables as CSV under the service's quoting rule, simulations, fits and reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwright.functions.text import csv_cell, js_number

FIT_COLUMNS = ("mumax", "Ks", "Yxs", "rmse_X", "r2_X", "rmse_S", "r2_S")


def csv_lines(rows: DataFrame, key: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, content): each key's rows as CSV with a header, in order; cells are quoted only where they must be."""
    line = F.concat_ws(",", *(csv_cell(c) for c in columns))
    body = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("rows"))
    return body.select(key, F.concat_ws("\n", F.lit(",".join(columns)), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("content"))


def simulation_csv(points: DataFrame, key: str = "id") -> DataFrame:
    """(key, content): three comment lines, a blank one, the header, and a line a point with four decimals."""
    line = F.concat_ws(",", js_number("t", 4), js_number("X", 4), js_number("S", 4))
    body = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", line.alias("line")))).alias("rows"))
    head = F.concat(F.lit("# Simulated series "), F.col(key).cast("string"), F.lit("\n# Chemostat with Monod growth, Runge-Kutta steps\n# time in h, X and S in g/L\n\ntime_h,X_g_per_L,S_g_per_L"))
    return body.select(key, F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("content"))


def fit_csv(fits: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, content): a line a fitted parameter and metric, six decimals."""
    lines = [F.concat(F.lit(f"{c},"), js_number(c, 6)) for c in FIT_COLUMNS]
    return fits.select(key, F.concat_ws("\n", F.lit("name,value"), *lines).alias("content"))


def fit_json(fits: DataFrame, key: str = "series_id") -> DataFrame:
    parameters, metrics = FIT_COLUMNS[:3], FIT_COLUMNS[3:]
    return fits.select(key, F.to_json(F.struct(F.struct(*parameters).alias("parameters"), F.struct(*metrics).alias("metrics"))).alias("content"))


#: Units of a fit's parameters, found and given, and of its metrics.
_FOUND, _GIVEN = {"mumax": "1/h", "Ks": "g/L", "Yxs": "g/g"}, {"D": "1/h", "Sin": "g/L", "X0": "g/L", "S0": "g/L"}
_METRICS = {"rmse_X": "g/L", "rmse_S": "g/L", "r2_X": "", "r2_S": ""}


def fit_report_csv(fits: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, content): all seven parameters of a fit, the fitted before the given ones, then its metrics; values with six decimals, and units."""
    lines = lambda units: [F.concat(F.lit(f"{c},"), js_number(c, 6), F.lit(f",{u}")) for c, u in units.items()]
    return fits.select(key, F.concat_ws("\n", F.lit("# Fitted parameters\nparameter,value,unit"), *lines(_FOUND | _GIVEN), F.lit("\n# Fit metrics"), *lines(_METRICS)).alias("content"))


def fit_report_json(fits: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, content): a fit as JSON with its fitted and given parameters and its metrics, each with value and unit."""
    part = lambda name, units: F.struct(*(F.struct(F.col(c).alias("value"), F.lit(u).alias("unit")).alias(c) for c, u in units.items())).alias(name)
    return fits.select(key, F.to_json(F.struct(part("fitted", _FOUND), part("given", _GIVEN), part("metrics", _METRICS))).alias("content"))


def wrapped(text: Column | str, prefix: str = "# ", width: int = 88) -> Column:
    """A text broken between words into lines of at most ``width`` characters with a prefix; longer words stay whole."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"))
    room = width - len(prefix)

    def step(a: Column, w: Column) -> Column:
        fits = (a["now"] == "") | (F.length(a["now"]) + 1 + F.length(w) <= room)
        return F.struct(F.when(fits, a["lines"]).otherwise(F.concat(a["lines"], F.array(a["now"]))).alias("lines"), F.when(a["now"] == "", w).when(fits, F.concat_ws(" ", a["now"], w)).otherwise(w).alias("now"))

    done = F.aggregate(words, start, step, lambda a: F.when(a["now"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["now"]))))
    return F.array_join(F.transform(done, lambda line: F.concat(F.lit(prefix), line)), "\n")


def write_report(rows: DataFrame, means: DataFrame, path: str, by: str = "provider") -> None:
    """A JSON document a provider: its fixtures' rows and their means."""
    nested = rows.groupBy(by).agg(F.collect_list(F.struct(*(c for c in rows.columns if c != by))).alias("fixtures"))
    means.select(by, F.struct(*(c for c in means.columns if c != by)).alias("means")).join(nested, by).write.mode("errorifexists").json(path)
