"""Scores of extractions against golden answers."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.functions.text import let, round_half_up, squash
from cardwright.operators.extract import symbol_list

#: Weights of the parts of the overall score, and pairs of unit spellings that count as equal. Fixed values.
WEIGHTS = {"variables": 0.25, "parameters": 0.25, "equations": 0.25, "units": 0.15, "missing_info": 0.10}
UNIT_ALIASES = (("g/l", "g·l-1"), ("1/h", "h-1"), ("l/h", "l·h-1"), ("mol/l", "mol·l-1"), ("µmol/m2/s", "µmol·m-2·s-1"), ("umol/m2/s", "µmol·m-2·s-1"))


def jaccard(found: Column, expected: Column) -> Column:
    """Of two sets of squashed texts; 1 if nothing is expected."""
    a, b = (F.array_distinct(F.transform(x, squash)) for x in (found, expected))
    return F.when(F.size(b) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.nullif(F.size(F.array_union(a, b)), F.lit(0)))


def recall(found: Column, expected: Column, least: float = 0.5) -> Column:
    """Share of the expected symbol sets of which some found set holds at least half; 1 if none is expected."""
    squashed = lambda sets: F.transform(sets, lambda s: F.array_distinct(F.transform(s, squash)))
    # names are squashed once a set, not once a pair of sets
    hit = let(F.struct(squashed(found).alias("found"), squashed(expected).alias("expected")), lambda x: F.filter(x["expected"], lambda e: F.exists(x["found"], lambda f: F.size(F.array_intersect(f, e)) >= least * F.size(e))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(hit).cast("double") / F.nullif(F.size(expected), F.lit(0)))


def equation_symbols(involved: Column | str, plaintext: Column | str, label: Column | str) -> Column:
    """The squashed symbols of an equation: those listed, as an array, a JSON array or with commas, and the names in its plain text and label."""
    text = F.concat(*(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (plaintext, F.lit(" "), label)))
    listed = F.coalesce(symbol_list(involved), F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(listed, tokens(text)), squash))


def tokens(text: Column) -> Column:
    """Names in a text: a letter, then letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0))


def plain_unit(c: Column | str) -> Column:
    t = F.regexp_replace(squash(c), "[·•]", "")
    t = F.regexp_replace(t, r"\^?(-?\d+)", "$1")
    return F.lower(F.translate(F.regexp_replace(t, "[⁻¹]", "-1"), "²³", "23"))


def same_unit(a: Column | str, b: Column | str) -> Column:
    """Equal when spelt plainly, or when one contains a spelling and the other its alias. Null is the empty unit."""
    x, y = plain_unit(a), plain_unit(b)
    out = x == y
    for p, q in UNIT_ALIASES:
        out = out | (F.contains(x, F.lit(p)) & F.contains(y, F.lit(q))) | (F.contains(x, F.lit(q)) & F.contains(y, F.lit(p)))
    return F.coalesce(out, F.lit(False))


def unit_scores(found: DataFrame, expected: DataFrame, key: str = "fixture") -> DataFrame:
    """(key, units): share of expected (key, symbol, unit) whose found unit is the same; of several found ones the last by ordinal."""
    last = found.groupBy(key, squash("symbol").alias("s")).agg(F.max_by(F.struct("unit"), "ordinal").alias("got"))
    joined = expected.withColumn("s", squash("symbol")).join(last, [key, "s"], "left")
    right = F.col("got").isNotNull() & same_unit(F.col("got.unit"), "unit")
    return joined.groupBy(key).agg(F.avg(F.when(right, 1.0).otherwise(0.0)).alias("units"))


def missing_info(listed: Column, limitations: Column, assumptions: Column) -> Column:
    """1 with missing information or limitations, 0.5 with assumptions only, else 0."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(some(listed) | some(limitations), 1.0).when(some(assumptions), 0.5).otherwise(0.0)


#: An expected answer, as its file has it.
GOLDEN = """
expected_variable_symbols array<string>, expected_parameter_symbols array<string>, expected_equation_symbol_sets array<array<string>>,
expected_variable_units map<string, string>, expected_parameter_units map<string, string>
"""


def fixtures(spark: SparkSession, texts: str, answers: str) -> DataFrame:
    """(fixture, text, golden): the .txt files of a folder beside the .json files of the same stem in another; a text without answer has a null one."""
    stem = lambda ending: F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{ending}$", 1).alias("fixture")
    left = spark.read.text(texts, wholetext=True, pathGlobFilter="*.txt").select(stem("txt"), F.col("value").alias("text"))
    right = spark.read.text(answers, wholetext=True, pathGlobFilter="*.json").select(stem("json"), F.from_json("value", GOLDEN).alias("golden"))
    return left.join(right, "fixture", "left")


def golden_scores(cards: DataFrame) -> DataFrame:
    """``cards`` with the five parts and the overall score.

    A card has doc (an extraction document) and golden (its expected answer). Symbols and units of variables come before those
    of parameters, and of equal symbols the last counts, in found and in expected ones. A null doc scores 0.
    """
    d, g = F.col("doc"), F.col("golden")
    names = lambda array: F.coalesce(F.transform(d[array], lambda x: x["symbol"]), F.array().cast("array<string>"))
    none = F.array().cast("array<array<string>>")
    found = F.coalesce(F.transform(d["equations"], lambda x: equation_symbols(F.to_json(x["variables_involved"]), x["equation_plaintext"], x["label"])), none)
    pairs = lambda array: F.coalesce(F.transform(d[array], lambda x: F.struct(squash(x["symbol"]).alias("s"), x["unit"].alias("u"))), F.array().cast("array<struct<s:string,u:string>>"))
    units = F.concat(pairs("state_variables"), pairs("parameters"))
    wanted = F.concat(*(F.coalesce(F.map_entries(g[f"expected_{kind}_units"]), F.array().cast("array<struct<key:string,value:string>>")) for kind in ("variable", "parameter")))
    wanted = F.filter(wanted, lambda x, i: ~F.exists(F.slice(wanted, i + 2, F.size(wanted)), lambda y: y["key"] == x["key"]))
    mine = lambda e: F.element_at(F.filter(units, lambda x: x["s"] == squash(e["key"])), -1)["u"]
    hits = F.filter(wanted, lambda e: (F.size(F.filter(units, lambda x: x["s"] == squash(e["key"]))) > 0) & same_unit(mine(e), e["value"]))
    parts = {
        "variables": jaccard(names("state_variables"), g["expected_variable_symbols"]), "parameters": jaccard(names("parameters"), g["expected_parameter_symbols"]),
        "equations": recall(found, g["expected_equation_symbol_sets"]), "units": F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(hits).cast("double") / F.nullif(F.size(wanted), F.lit(0))),
        "missing_info": missing_info(d["model_card"]["missing_information"], d["limitations"], d["assumptions"]),
    }
    return overall(cards.withColumns({k: F.when(d.isNull(), 0.0).otherwise(c) for k, c in parts.items()}))


def overall(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``scores`` with overall; the weighted sum is of the unrounded parts, then all are rounded to two digits."""
    weights = weights or WEIGHTS
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * w
    return scores.withColumns({"overall": round_half_up(total, 2)}).withColumns({c: round_half_up(c, 2) for c in weights})


def report(scored: DataFrame, by: str = "provider", weights: dict[str, float] | None = None) -> DataFrame:
    """Means of the rounded rows by provider, rounded again, with the number of fixtures."""
    columns = [*(weights or WEIGHTS), "overall"]
    return scored.groupBy(by).agg(F.count("*").alias("fixtures"), *(round_half_up(F.avg(c), 2).alias(c) for c in columns))


def error_scores(rows: DataFrame, keys: list[str], observed: str, predicted: str) -> DataFrame:
    """(keys, n, rmse, r2): r2 is 1 where the observed values do not vary."""
    o, p = F.col(observed), F.col(predicted)
    means = rows.groupBy(*keys).agg(F.avg(o).alias("_mean")) if keys else rows.agg(F.avg(o).alias("_mean"))
    joined = rows.join(means, keys) if keys else rows.crossJoin(F.broadcast(means))  # one row
    out = joined.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((o - p) ** 2).alias("res"), F.sum((o - F.col("_mean")) ** 2).alias("tot"))
    return out.select(*keys, "n", F.sqrt(F.col("res") / F.col("n")).alias("rmse"), F.when(F.col("tot") == 0, 1.0).otherwise(1 - F.col("res") / F.nullif("tot", F.lit(0.0))).alias("r2"))


def mean_square(c: Column | str) -> Column:
    """Aggregate: mean of squares, at least 1e-6."""
    x = F.col(c) if isinstance(c, str) else c
    return F.greatest(F.lit(1e-6), F.avg(x * x))
