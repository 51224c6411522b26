"""Symbols over several sources: what each says of a symbol, and where they disagree."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwright.functions.text import norm, trim_all
from cardwright.sources.work import buckets

#: Severities by kind of conflict. Fixed values.
SEVERITY = {"parameter_value": "high", "parameter_unit": "high", "variable_definition": "medium", "equation": "medium", "missing_across_sources": "low"}


#: Under this name the symbols themselves go with the values.
SYMBOL = "symbol as written"
#: Values of a set that are shown, the first seen ones; sizes always count all.
SHOWN = 1_000
#: Rows of a symbol at most that are dealt by symbol.
OFTEN = 10_000


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def seen_values(rows: DataFrame, symbol: str = "symbol", values: tuple[str, ...] = ("value", "unit", "meaning", "source"), order: tuple[str, ...] = ("extraction_id", "ordinal")) -> DataFrame:
    """(key, name, v, seen): for each symbol, trimmed and case folded, its distinct values as rows, each with the place where it is first seen.

    ``name`` tells which of ``values`` it is, or ``SYMBOL`` for the symbol as written. Blank symbols are skipped, and so are
    values that are null or empty; of "value" also blank ones. Grouped by value, so a symbol with any number of values is no larger group than others.
    """
    return _seen(rows.withColumns({"key": norm(symbol), "seen": F.struct(*order)}).where("key != ''"), symbol, values)


def _seen(keyed: DataFrame, symbol: str, values: tuple[str, ...]) -> DataFrame:
    """``seen_values`` of rows with key and seen; without an exchange where they are dealt by key."""
    items = F.array(*(F.struct(F.lit(name).alias("name"), _text(c).alias("v")) for name, c in ((SYMBOL, symbol), *((v, v) for v in values))))
    one = keyed.select("key", "seen", F.explode(items).alias("x")).select("key", "x.name", "x.v", "seen")
    there = F.when(F.col("name") == "value", trim_all("v")).otherwise(F.col("v")) != ""
    return one.where(there | (F.col("name") == SYMBOL)).groupBy("key", "name", "v").agg(F.min("seen").alias("seen"))


def set_sizes(seen: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """(key, n_<value>s ...): sizes of a symbol's sets, from ``seen_values``."""
    # "seen" is never null; named, it keeps the plan of the values as ``first_values`` has it, so that both share one exchange
    return seen.groupBy("key").agg(*(F.count_if((F.col("name") == v) & F.col("seen").isNotNull()).alias(f"n_{v}s") for v in values))


def first_values(seen: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first ``shown`` values of each symbol's sets; tasks keep no more than these before they are dealt by symbol."""
    place = F.row_number().over(Window.partitionBy("key", "name").orderBy("seen", "v"))
    return seen.withColumn("place", place).where(F.col("place") <= shown)


def _sets(keyed: DataFrame, symbol: str, values: tuple[str, ...], shown: int, n: int) -> DataFrame:
    """The rows of ``aggregated`` of symbols with few rows (key, seen, the symbol and ``values``), which are dealt by symbol once, to ``n`` tasks."""
    seen = _seen(keyed.repartition(n, "key"), symbol, values)
    placed = seen.withColumn("place", F.row_number().over(Window.partitionBy("key", "name").orderBy("seen", "v")))
    some = F.when(F.col("place") <= shown, F.struct("name", "place", "v"))
    return placed.groupBy("key").agg(F.array_sort(F.collect_list(some)).alias("all"), *(F.count_if(F.col("name") == v).alias(f"n_{v}s") for v in values))


def aggregated(rows: DataFrame, symbol: str = "symbol", values: tuple[str, ...] = ("value", "unit", "meaning", "source"), order: tuple[str, ...] = ("extraction_id", "ordinal"), shown: int = SHOWN) -> DataFrame:
    """One row a symbol, trimmed and case folded: key, the symbol as first written, for each of ``values`` the set in first-seen order (``<value>s``) and its size (``n_<value>s``).

    Sets of symbols with more than ``OFTEN`` rows stay rows (``seen_values``) until only the first ``shown`` of each are left, so a symbol with a million
    values costs no task more than others; beyond ``shown`` the size tells that there are more. Rows of all others are dealt once, by symbol.
    """
    keyed = rows.withColumns({"key": norm(symbol), "seen": F.struct(*order)}).where("key != ''")
    # a key for each OFTEN rows at most
    counted = keyed.groupBy("key").count().agg(F.sum("count").alias("n"), F.collect_list(F.when(F.col("count") > OFTEN, F.col("key"))).alias("often")).first()
    often, n = counted.often, buckets(rows.sparkSession, (counted.n or 0) * (1 + len(values)))
    needed = keyed.select("key", "seen", *dict.fromkeys((symbol, *values)))
    if often:
        spread = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in often], "key string"))
        seen = _seen(needed.join(spread, "key", "left_semi"), symbol, values)
        kept = first_values(seen, shown).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("name", "place", "v"))).alias("all"))
        sets = _sets(needed.join(spread, "key", "left_anti"), symbol, values, shown, n).unionByName(kept.join(set_sizes(seen, values), "key"))
    else:
        sets = _sets(needed, symbol, values, shown, n)
    of = lambda name: F.transform(F.filter("all", lambda x: x["name"] == name), lambda x: x["v"])
    return sets.select("key", F.element_at(of(SYMBOL), 1).alias(symbol), *(of(v).alias(f"{v}s") for v in values), *(f"n_{v}s" for v in values))


def distinct_texts(rows: DataFrame, text: str = "text", order: tuple[str, ...] = ("extraction_id", "ordinal")) -> DataFrame:
    """(text, seen): the texts of all sources, each once exactly as written, with the place where it is first seen; null and empty ones are left out."""
    there = rows.where(F.col(text) != "").select(F.col(text).alias("text"), F.struct(*order).alias("seen"))
    return there.groupBy(F.sha2("text", 256).alias("key")).agg(F.min_by("text", "seen").alias("text"), F.min("seen").alias("seen")).select("text", "seen")


def of_source(rows: DataFrame, source: str | None) -> DataFrame:
    """Rows of one source; None or "all" keeps those of all."""
    return rows if source in (None, "all") else rows.where(F.col("source") == source)


def equation_key() -> Column:
    return F.coalesce(*(F.nullif(norm(c), F.lit("")) for c in ("label", "plaintext", "latex")))


def equation_forms(equations: DataFrame, order: tuple[str, ...] = ("extraction_id", "ordinal"), shown: int = SHOWN) -> DataFrame:
    """(key, display, forms, n_forms): equations by label, else plain text, else LaTeX; their distinct forms, as written, in first-seen order.

    Keys are trimmed and case folded, forms are not: two that differ in a letter's case or in a space are two. ``display`` is the label of the first
    equation, which may be empty, or the key where it has none.
    """
    keyed = equations.withColumns({"equation": equation_key(), "form": F.coalesce(F.nullif("plaintext", F.lit("")), F.nullif("latex", F.lit("")))}).where(F.col("equation").isNotNull())
    first = keyed.groupBy(F.col("equation").alias("key")).agg(F.min_by(F.coalesce("label", "equation"), F.struct(*order)).alias("display"))
    return aggregated(keyed, "equation", ("form",), order, shown).join(first, "key").select("key", "display", "forms", "n_forms")


def conflicts(parameters: DataFrame, variables: DataFrame, equations: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, severity, subject, details): disagreements between sources.

    ``parameters``, ``variables`` and ``equations`` are of the shape that ``aggregated`` and ``equation_forms`` take, with
    source; ``sources`` has source and extraction_id. Sources of one title are one, of which the last extraction counts.
    """
    p, v, e = aggregated(parameters), aggregated(variables, values=("unit", "meaning", "source")), equation_forms(equations)
    row = lambda df, kind, subject, details: df.select(F.lit(kind).alias("kind"), F.lit(SEVERITY[kind]).alias("severity"), subject.alias("subject"), details.alias("details"))
    several = lambda name: F.col(f"n_{name}") > 1
    more = lambda name: F.when(F.col(f"n_{name}") > F.size(name), F.concat(F.lit(" | and "), F.col(f"n_{name}") - F.size(name), F.lit(" more"))).otherwise("")
    text = lambda name: F.concat(F.array_join(name, " | "), more(name))
    last = sources.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("extraction_id")))).where("n = 1").select("source", "extraction_id")
    own = parameters.join(last, ["source", "extraction_id"]).select(norm("symbol").alias("key"), "source").where("key != ''").distinct()
    all_sources = last.agg(F.coalesce(F.array_sort(F.collect_list("source")), F.array().cast("array<string>")).alias("all_sources"))
    present = own.groupBy("key").agg(F.collect_set("source").alias("present")).crossJoin(F.broadcast(all_sources))  # one row
    found = lambda kind, here, subject, details: F.when(here, F.struct(F.lit(kind).alias("kind"), F.lit(SEVERITY[kind]).alias("severity"), subject.alias("subject"), details.alias("details")))
    # all kinds of a symbol's row at once, so that its sets are made once
    by_symbol = p.join(present, "key", "left").withColumn("missing", F.array_except("all_sources", "present"))
    kinds = F.array(
        found("parameter_value", several("values"), F.col("symbol"), text("values")),
        found("parameter_unit", several("units"), F.col("symbol"), text("units")),
        found("missing_across_sources", F.size("missing") > 0, F.col("symbol"), F.array_join("missing", " | ")),
    )
    parts = [
        by_symbol.select(F.explode(F.array_compact(kinds)).alias("x")).select("x.*"),
        row(v.where(several("units") | several("meanings")), "variable_definition", F.col("symbol"), F.concat_ws(" / ", text("units"), text("meanings"))),
        row(e.where(several("forms")), "equation", F.col("display"), text("forms")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
