"""Files that go with a model card: a simulation script, a notebook, tables and reports; texts are put together by columns."""

import io
import zipfile
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwright.functions.text import csv_cell, slug, trim_all
from cardwright.operators import reproducibility, templates, units
from cardwright.sources.work import unsent

FILES = (
    "README.md", "model_card.md", "variables.csv", "parameters.csv", "equations.md", "assumptions.md", "limitations.md", "missing_information.md", "reproducibility_report.json",
    "unit_check_report.json", "raw_extraction.json", "simulate.py", "model_notebook.ipynb", "requirements.txt", "source_excerpt.txt",
)
_KEY = "extraction_id"


class Lines(NamedTuple):
    """Lines of a card's text ``name``: ``line`` of ``rows`` (extraction_id, ordinal), in order; null lines are left out."""

    name: str
    rows: DataFrame
    line: Column
    ordinal: Column | None = None


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are worked out once a row: what names them is not given a copy of their expressions, as a generator stands between."""
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return df.withColumn("_made", made).select(*(F.col(c) for c in df.columns), "_made.*")


def gathered(cards: DataFrame, parts: list[Lines]) -> tuple[DataFrame, Callable[[str], Column]]:
    """(cards, of): cards (extraction_id, title) with all their lines, and the column function ``of``, which gives the array of a name's lines.

    Cards and lines of all names are dealt by card together, so there is one exchange however many texts are put together.
    """
    row = lambda df, name, ordinal, line: df.select(_KEY, F.lit(name).alias("name"), ordinal.cast("long").alias("ordinal"), line.alias("line"))
    head = row(cards, "title", F.lit(0), F.coalesce("title", F.lit("")))
    rest = [row(p.rows, p.name, F.col("ordinal") if p.ordinal is None else p.ordinal, p.line).where(F.col("line").isNotNull()) for p in parts]
    dealt = reduce(DataFrame.union, rest, head).repartition(_KEY)  # both groupings below find a card's rows together
    texts = dealt.groupBy(_KEY, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]).alias("lines"))
    found = texts.groupBy(_KEY).agg(F.map_from_entries(F.collect_list(F.struct("name", "lines"))).alias("by_name"))
    own = lambda name: F.coalesce(F.try_element_at("by_name", F.lit(name)), F.array().cast("array<string>"))
    found = _once(found, {"titles": F.try_element_at("by_name", F.lit("title"))} | {f"lines_{p.name}": own(p.name) for p in parts})
    return found.withColumn("title", F.explode("titles")).drop("by_name", "titles"), lambda name: F.col(f"lines_{name}")


def _text(lines: Column) -> Column:
    """Lines as a text; null where there are none."""
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def number_text(c: Column) -> Column:
    """A number for code: whole ones without point, those under 0.001 and over a million with an exponent, all digits kept."""
    small = (F.abs(c) > 0) & ((F.abs(c) < 1e-3) | (F.abs(c) > 1e6))
    shown = F.regexp_replace(c.cast("string"), r"^(-?\d)(\d{6})\.(\d+)$", "$1.$2$3e6")
    power = F.regexp_replace(F.regexp_replace(F.lower(shown), r"\.?0*e", "e"), r"e(\d)", "e+$1")
    return F.when(c.isNull() | F.isnan(c), "None").when(small, power).when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def _name(c: str) -> Column:
    return F.regexp_replace(F.col(c), r"[^A-Za-z0-9_]", "_")


#: The line above and below a section's name, and the units of time looked for, in this order. Fixed values.
DIVIDER = "# " + "=" * 76
TIME_UNITS = {"h": r"/h(?![A-Za-z0-9_])|per.h(?![A-Za-z0-9_])|h\^\{?-1|1/h", "d": r"/d(?![A-Za-z0-9_])|per.d(?![A-Za-z0-9_])|/day", "min": r"/min(?![A-Za-z0-9_])|per.min", "s": r"/s(?![A-Za-z0-9_])|per.s(?![A-Za-z0-9_])|1/s"}
_SECTION = rf"(?:^|\n){DIVIDER}\n# ([^\n]+)\n{DIVIDER}"


def sections(code: Column | str) -> Column:
    """Map from the names of a script's sections to their texts, trimmed; what comes before the first one is left out."""
    c = F.col(code) if isinstance(code, str) else code
    names = F.transform(F.regexp_extract_all(c, F.lit(_SECTION), F.lit(1)), trim_all)
    bodies = F.transform(F.slice(F.split(c, _SECTION), 2, F.greatest(F.size(names), F.lit(1))), trim_all)
    pairs = F.arrays_zip(names.alias("name"), bodies.alias("body"))
    last = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), x["name"]))
    return F.map_from_entries(last)


def time_units(cards: DataFrame, variables: DataFrame, parameters: DataFrame) -> DataFrame:
    """(extraction_id, time_unit): the unit of time that a card's units divide by, h before d, min and s; h if none does."""
    every = parameters.select(_KEY, "unit").unionByName(variables.select(_KEY, "unit")).where(F.col("unit").isNotNull())
    found = every.groupBy(_KEY).agg(*(F.bool_or(F.regexp_like("unit", F.lit(p))).alias(f"_{u}") for u, p in TIME_UNITS.items()))
    unit = F.coalesce(*(F.when(F.col(f"_{u}"), F.lit(u)) for u in TIME_UNITS), F.lit("h"))
    return cards.select(_KEY).join(unsent(found), _KEY, "left").select(_KEY, unit.alias("time_unit"))


def lhs_symbol(text: Column | str) -> Column:
    """The name before a text's first = or :, or null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(c, r"^([A-Za-z_][A-Za-z0-9_]*)\s*[=:]", 1), F.lit(""))


def initial_states(variables: DataFrame, raw: DataFrame | None) -> DataFrame:
    """(extraction_id, ordinal, symbol, unit, start) of state variables; start is the number that the provider's document (extraction_id, raw) gives as
    the initial condition of the first variable of that name, or null."""
    states = variables.where("role = 'state'").select(_KEY, "ordinal", "symbol", "unit", F.lower("symbol").alias("s"))
    if raw is None:
        return states.withColumn("start", F.lit(None).cast("double")).drop("s")
    said = raw.select(_KEY, F.posexplode(F.from_json(F.get_json_object("raw", "$.state_variables"), "array<struct<symbol:string,initial_condition:string>>")).alias("k", "x"))
    first = said.groupBy(_KEY, F.lower(trim_all("x.symbol")).alias("s")).agg(F.min_by(F.struct("x.initial_condition"), "k").alias("first"))
    return states.join(unsent(first), [_KEY, "s"], "left").withColumn("start", trim_all("first.initial_condition").try_cast("double")).drop("s", "first")


def _script_lines(equations: DataFrame, variables: DataFrame, parameters: DataFrame, raw: DataFrame | None) -> list[Lines]:
    matched = templates.match(equations, variables, parameters)
    shown = F.regexp_replace(F.coalesce(F.when(F.trim("latex") != "", F.col("latex")), F.col("description"), F.lit("")), r"[\r\n]+", " ")
    todo = matched.where("kind = 'unmatched'").join(unsent(equations.select(_KEY, "ordinal", shown.alias("shown"))), [_KEY, "ordinal"])
    left = F.concat(F.lit("    # TODO: "), "shown", F.coalesce(F.concat(F.lit("\n    "), F.when(~F.col("shown").rlike(r"d[A-Za-z]+\s*/\s*dt"), lhs_symbol("shown")), F.lit(" = 0.0")), F.lit("")))
    states = initial_states(variables, raw)
    name, unit = _name("symbol"), F.when(F.coalesce("unit", F.lit("")) != "", F.col("unit")).otherwise("no unit")
    rates = matched.where("kind = 'derivative'").select(_KEY, F.lower("state").alias("s"), "code", "missing")
    each = states.withColumn("s", F.lower("symbol")).join(unsent(rates), [_KEY, "s"], "left")
    lacking = F.concat(F.lit("d"), name, F.lit("dt = 0.0  # TODO: "), F.when(F.size("missing") > 0, F.concat(F.lit("missing symbols: "), F.array_join("missing", ", "))).otherwise("no equation matched"))
    quoted = F.to_json(F.array("symbol")).substr(F.lit(2), F.length(F.to_json(F.array("symbol"))) - 2)
    values = F.concat(F.lit("    "), quoted, F.lit(": "), number_text(F.col("value")), F.lit(",  # "), unit, F.when(F.col("value").isNull(), F.lit("; TODO: value")).otherwise(""))
    divides = [(k, F.when(F.regexp_like("unit", F.lit(p)), F.lit(u))) for k, (u, p) in enumerate(TIME_UNITS.items())]
    return [
        Lines("values", parameters, values), Lines("taken", parameters, F.concat(F.lit("    "), name, F.lit(" = p["), quoted, F.lit("]"))),
        Lines("algebra", matched.where("kind = 'matched'"), F.concat(F.lit("    "), "code")), Lines("rates", each, F.concat(F.lit("    "), F.coalesce("code", lacking))), Lines("todo", todo, left),
        Lines("starts", states, F.concat(F.lit("    "), F.coalesce(number_text(F.col("start")), F.lit("None")), F.lit(",  # "), "symbol", F.lit(", "), unit)), Lines("states", states, name),
        *(Lines("time_units", rows, F.coalesce(*(u for _, u in divides)), F.coalesce(*(F.when(u.isNotNull(), F.lit(k)) for k, u in divides))) for rows in (parameters, variables)),
        Lines("runnable", matched, F.when(F.col("runnable"), F.lit("x"))),
    ]


def _script(of: Callable[[str], Column]) -> Column:
    """The script's text, from a card's lines."""
    names = of("states")
    time_unit = F.coalesce(F.try_element_at(of("time_units"), F.lit(1)), F.lit("h"))
    some = F.size(names) > 0
    unpack = F.when(some, F.concat(F.lit("    "), F.array_join(names, ", "), F.lit(", = y"))).otherwise(F.lit("    # TODO: no state variables"))
    back = F.concat(F.lit("    return ["), F.array_join(F.transform(names, lambda x: F.concat(F.lit("d"), x, F.lit("dt"))), ", "), F.lit("]"))
    starts = F.regexp_replace(F.array_join(of("starts"), "\n"), "(?m)^    None,", "    0.0,  # TODO: set;")
    head = lambda title: F.lit(f"\n{DIVIDER}\n# {title}\n{DIVIDER}\n")
    plots = F.array_join(F.transform(names, lambda x, i: F.concat(F.lit("axes["), i.cast("string"), F.lit("].plot(solution.t, solution.y["), i.cast("string"), F.lit('], label="'), x, F.lit('")\naxes['), i.cast("string"), F.lit("].legend()"))), "\n")
    values, taken, algebra, todo, rates = (_text(of(name)) for name in ("values", "taken", "algebra", "todo", "rates"))
    return F.concat_ws(
        "\n", F.concat(F.lit('"""Simulation of '), F.regexp_replace("title", '["\\\\]', "'"), F.lit('."""')), head("IMPORTS"), F.lit("import matplotlib.pyplot as plt\nimport numpy as np\nfrom scipy.integrate import solve_ivp"),
        head("PARAMETERS"), F.lit("params = {"), values, F.lit("}"), head("INITIAL STATES"), F.lit("y0 = ["), F.nullif(starts, F.lit("")), F.lit("]"),
        head("MODEL"), F.lit("def rhs(t, y, p):"), unpack, taken, algebra, todo, rates, back,
        head("SIMULATION"), F.concat(F.lit("t_span = (0.0, 100.0)  # in "), time_unit), F.lit("t_eval = np.linspace(*t_span, 500)\nsolution = solve_ivp(rhs, t_span, y0, args=(params,), t_eval=t_eval, rtol=1e-6, atol=1e-9)\nif not solution.success:\n    raise RuntimeError(solution.message)"),
        head("PLOT"), F.concat(F.lit("figure, axes = plt.subplots("), F.greatest(F.size(names), F.lit(1)).cast("string"), F.lit(", 1, sharex=True, squeeze=False)\naxes = axes[:, 0]")), F.nullif(plots, F.lit("")), F.concat(F.lit('axes[-1].set_xlabel("time in '), time_unit, F.lit('")\nplt.savefig("simulation.png")\n')),
    )


def scripts(cards: DataFrame, equations: DataFrame, variables: DataFrame, parameters: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """(extraction_id, title, code, runnable): a Python script in sections: parameters, initial states, right-hand sides, solution and plot.

    Right-hand sides come from the templates that match; equations without one, states without a derivative, and values that
    the card lacks are marked TODO. Initial states are those of ``raw``, the provider's documents, where these give numbers.
    """
    found, of = gathered(cards, _script_lines(equations, variables, parameters, raw))
    return found.select(_KEY, "title", _script(of).alias("code"), F.size(of("runnable")).cast("long").alias("runnable"))


def notebook(c: dict[str, Column]) -> Column:
    """A notebook of 14 cells as JSON: texts first and last, the script's sections between."""
    head = lambda title, body: F.concat(F.lit(f"## {title}\n\n"), F.coalesce(body, F.lit("None.")))
    part = lambda name: F.coalesce(F.try_element_at(sections(c["code"]), F.lit(name)), F.lit(f"# TODO: {name.lower()}"))
    texts = [F.concat(F.lit("# "), c["title"]), head("Equations", c["equations"]), head("Variables", c["variables"]), head("Parameters", c["parameters"]), head("Assumptions", c["assumptions"]), head("Limitations", c["limitations"]), head("Missing information", c["missing"])]
    codes = [part(name) for name in ("IMPORTS", "PARAMETERS", "INITIAL STATES", "MODEL", "SIMULATION", "PLOT")]
    end = F.lit("## Notes\n\nMade from the card; check every value against the source.")
    none = F.expr("map()").cast("map<string,string>").alias("metadata")
    text = lambda x: F.to_json(F.struct(F.lit("markdown").alias("cell_type"), none, x.alias("source")))
    code = lambda x: F.to_json(F.struct(F.lit("code").alias("cell_type"), none, F.lit(None).cast("int").alias("execution_count"), F.array().cast("array<string>").alias("outputs"), x.alias("source")), {"ignoreNullFields": "false"})
    cells = F.array(*map(text, texts), *map(code, codes), text(end))
    return F.concat(F.lit('{"nbformat": 4, "nbformat_minor": 5, "metadata": {}, "cells": ['), F.array_join(cells, ", "), F.lit("]}"))


def distinct_quotes(equations: DataFrame, variables: DataFrame, parameters: DataFrame) -> DataFrame:
    """(extraction_id, q, ordinal): a card's quotes, trimmed and each once, in the order equations, variables, parameters; blank ones are left out."""
    quotes = equations.select(_KEY, "ordinal", "source_quote", F.lit(0).alias("k")).union(variables.select(_KEY, "ordinal", "source_quote", F.lit(1))).union(parameters.select(_KEY, "ordinal", "source_quote", F.lit(2)))
    some = quotes.where(F.trim(F.coalesce("source_quote", F.lit(""))) != "")
    return some.groupBy(_KEY, F.trim("source_quote").alias("q")).agg(F.min(F.struct("k", "ordinal")).alias("ordinal"))


def package(cards: DataFrame, equations: DataFrame, variables: DataFrame, parameters: DataFrame, assumptions: DataFrame | None = None, reports: DataFrame | None = None) -> DataFrame:
    """(extraction_id, filename, content): the 15 files of each card (extraction_id, title).

    ``assumptions`` has extraction_id, ordinal, kind, text; ``reports`` has extraction_id and any of missing, report, raw, a row a card. Without a report, the
    reproducibility report is worked out from the card, with system_description, problem_statement and ode_template where ``cards`` has them.
    """
    spark = cards.sparkSession
    if assumptions is None:
        assumptions = spark.createDataFrame([], f"{_KEY} long, ordinal int, kind string, text string")
    csv = lambda *columns: F.concat_ws(",", *(csv_cell(c) for c in columns))
    mark = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\\|", "\\\\|"), "`", "'")
    known = set(reports.columns) if reports is not None else set()
    raw = reports.select(_KEY, "raw") if "raw" in known else None
    if "report" not in known:
        texts = cards.withColumnRenamed(_KEY, "id")
        texts = texts if raw is None else texts.join(unsent(raw.select(F.col(_KEY).alias("id"), F.col("raw").alias("raw_extraction_json"))), "id", "left")
        own = reproducibility.report(texts, equations, variables, parameters)
    checks = _once(units.formal(equations, units.dimension_map(variables, parameters)), {"check": F.to_json(F.struct("ordinal", "pattern", "parsed", "matches", "issues"))})
    quote = F.when(trim_all(F.coalesce("source_quote", F.lit(""))) != "", trim_all("source_quote"))
    parts = [
        *_script_lines(equations, variables, parameters, raw),
        Lines("v_csv", variables, csv("symbol", "name", "unit", "role")), Lines("p_csv", parameters, csv("symbol", "name", F.col("value").cast("string"), "unit", "confidence")),
        Lines("v_md", variables, F.concat(F.lit("- `"), mark("symbol"), F.lit("` "), mark("name"), F.lit(" ["), mark("unit"), F.lit("]"))), Lines("p_md", parameters, F.concat(F.lit("- `"), mark("symbol"), F.lit("` = "), number_text(F.col("value")), F.lit(" "), mark("unit"))),
        Lines("e_md", equations, F.concat(F.lit("$$"), F.coalesce("latex", F.lit("")), F.lit("$$\n\n"), F.coalesce("description", F.lit("")), F.lit("\n"))),
        Lines("a_md", assumptions.where("kind = 'assumption'"), F.concat(F.lit("- "), "text")), Lines("l_md", assumptions.where("kind = 'limitation'"), F.concat(F.lit("- "), "text")),
        *(Lines(f"quotes_{k}", rows, quote) for k, rows in enumerate((equations, variables, parameters))),
        Lines("unit_report", checks, F.col("check")),
        *(Lines(name, reports if name in known else cards, F.col(name) if name in known else F.lit(None).cast("string"), F.lit(0)) for name in ("missing", "raw")),
        Lines("report", reports if "report" in known else own, F.col("report"), F.lit(0)),
    ]
    found, of = gathered(cards, parts)
    texts = {name: _text(of(name)) for name in ("v_csv", "p_csv", "v_md", "p_md", "e_md", "a_md", "l_md", "missing", "report", "raw")}
    quotes = F.array_join(F.array_distinct(F.concat(*(of(f"quotes_{k}") for k in range(3)))), "\n")
    out = _once(found, {"code": _script(of), "quotes": quotes, "unit_report": F.concat(F.lit("["), F.array_join(of("unit_report"), ","), F.lit("]"))} | texts)
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    block = lambda title, c: F.concat(F.lit(f"# {title}\n\n"), F.coalesce(c, F.lit("None.")), F.lit("\n"))
    table = lambda header, c: F.concat_ws("\n", F.lit(header), c)
    book = {"title": F.col("title"), "equations": F.col("e_md"), "variables": F.col("v_md"), "parameters": F.col("p_md"), "assumptions": F.col("a_md"), "limitations": F.col("l_md"), "missing": given("missing", "None."), "code": F.col("code")}
    contents = {
        "README.md": F.concat(F.lit("# "), "title", F.lit("\n\nFiles made from the model card:\n\n" + "\n".join(f"- {f}" for f in FILES) + "\n")),
        "model_card.md": F.concat(block("Equations", F.col("e_md")), F.lit("\n"), block("Variables", F.col("v_md")), F.lit("\n"), block("Parameters", F.col("p_md"))),
        "variables.csv": table("symbol,name,unit,role", F.col("v_csv")), "parameters.csv": table("symbol,name,value,unit,confidence", F.col("p_csv")),
        "equations.md": block("Equations", F.col("e_md")), "assumptions.md": block("Assumptions", F.col("a_md")), "limitations.md": block("Limitations", F.col("l_md")),
        "missing_information.md": block("Missing information", given("missing", "None.")), "reproducibility_report.json": given("report", "{}"), "unit_check_report.json": F.coalesce("unit_report", F.lit("[]")),
        "raw_extraction.json": given("raw", '{\n  "_note": "No raw extraction."\n}'), "simulate.py": F.col("code"), "model_notebook.ipynb": notebook(book), "requirements.txt": F.lit("numpy\nscipy\nmatplotlib\n"), "source_excerpt.txt": F.coalesce("quotes", F.lit("")),
    }
    files = F.array(*(F.struct(F.lit(f).alias("filename"), contents[f].alias("content")) for f in FILES))
    return out.select(_KEY, F.explode(files).alias("f")).select(_KEY, "f.filename", "f.content")


def archive_name(title: Column) -> Column:
    return F.concat(slug(title), F.lit(".zip"))


def archive(files: DataFrame, extraction_id: int) -> bytes:
    """One card's files in a ZIP, in the folder model_package."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.where(F.col(_KEY) == extraction_id).orderBy("filename").toLocalIterator():
            z.writestr(f"model_package/{r['filename']}", r["content"] or "")
    return out.getvalue()
