"""Unit checks of model cards: formal dimension checks of known equation shapes, and heuristic rules; all as DataFrame plans."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwright.functions.text import has_text, has_word, identifiers, trim_all
from cardwright.functions.units import DIM, RATE, dim, is_dim, label, matched, minus, normal_equation, parse_unit, same_dim
from cardwright.sources.work import unsent

#: Equation shapes on normal texts. Fixed values.
MONOD = r"^([a-z_][A-Za-z0-9_]*)\s*=\s*([a-z_][A-Za-z0-9_]*)\s*\*\s*([a-z_][A-Za-z0-9_]*)\s*/\s*\(\s*([a-z_][A-Za-z0-9_]*)\s*[+]\s*([a-z_][A-Za-z0-9_]*)\s*\)"
ODE = r"(?<![A-Za-z0-9_])d([a-z_][A-Za-z0-9_]*)\s*/\s*dt\s*="
BIOMASS = r"d([a-z_][A-Za-z0-9_]*)\s*/\s*dt\s*=\s*\(?\s*([a-z_][A-Za-z0-9_]*)\s*-\s*([a-z_][A-Za-z0-9_]*)\s*\)?\s*\*?\s*\1"
BIOMASS_APART = r"d([a-z_][A-Za-z0-9_]*)\s*/\s*dt\s*=\s*([a-z_][A-Za-z0-9_]*)\s*\*\s*\1\s*-\s*([a-z_][A-Za-z0-9_]*)\s*\*\s*\1"
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
YIELD_GATE = rf"{_B}yxs{_E}|{_B}y_xs{_E}|{_B}y_?[xp][a-z]*{_E}"
YIELD = rf"{_B}(y[a-z_0-9]*){_E}"
KLA = rf"{_B}(?:kla|k_la|kl_a){_E}"

#: Classes of symbols by their names, tested in this order, and shapes of units. Fixed values.
SYMBOL_CLASSES = {
    "rate": ("(?i)^mu$", "(?i)^mu_?max$", "^[dD]$", "^k_?[dD]$", "^k_?[lL][aA]$", "^q_?[oO]2$", "^[kK]_?[hH]$", "(?i)^[kK]_?[sS]$"),
    "concentration": ("^[XSCPNO]$", "^X_?[a-z]+$", "^S_?[a-z]+$", "^C_?[a-z]+$"), "ratio": ("(?i)^Y[a-z]{0,4}$", "(?i)^yield$"),
}
UNIT_SHAPES = {
    "rate": (r"^1\s*/", rf"^per[-\s]?(h|day|hour|min|d){_E}", r"/\s*(h|hr|d|day|min|s)\s*$", r"[({](h|d|day|min|s|hr)[^)]*\s*\^?\s*-\s*1"),
    "concentration": (r"(?i)g\s*/\s*(l|m3|dm3)|mol\s*/\s*l|kg\s*/\s*m3|mg\s*/\s*l|mmol\s*/\s*l|g\s*cdw",),
    "ratio": (r"^$", "^-$", "^—$", "^dimensionless$", "^1$", r"^g\s*/\s*g", r"^mol\s*/\s*mol", r"^kg\s*/\s*kg"),
}
GAS_WORDS = ("oxygen", "o2", "co2", "carbon dioxide", "henry", "gas-liquid", "gas transfer", "kla", "k_la", "equilibrium concentration")
#: LaTeX words that are no symbols. Fixed values.
LATEX_WORDS = tuple("""frac cdot times left right text mathrm mathbf min max exp ln log sin cos tan sqrt sum int infty Delta partial nabla quad qquad pm mp over div hat bar dot
vec alpha beta gamma delta epsilon zeta eta theta lambda xi pi rho sigma tau phi chi psi omega Gamma Lambda Sigma Phi Psi Omega dt in notin to and or not if else""".split())


def symbol_map(variables: DataFrame, parameters: DataFrame, lower: bool) -> DataFrame:
    """(extraction_id, symbols): map from symbol to (symbol, unit, source). Variables come before parameters, the last of equal variables and the first of equal parameters count; with ``lower``, keys are lower case."""
    key = F.lower("symbol") if lower else F.col("symbol")
    part = lambda df, source, rank, sign: df.where(F.coalesce("symbol", F.lit("")) != "").select("extraction_id", key.alias("key"), F.struct(F.col("symbol"), F.col("unit"), F.lit(source).alias("source")).alias("v"), F.struct(F.lit(rank).alias("r"), (F.col("ordinal") * sign).alias("o")).alias("rank"))
    first = lambda rows, name: rows.groupBy("extraction_id", "key").agg(F.min_by("v", "rank").alias("v")).groupBy("extraction_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias(name))
    # the two are joined by card: rows dealt by card need no exchange for that, as they would if both were grouped as one table
    both = first(part(variables, "variable", 0, -1), "v").join(unsent(first(part(parameters, "parameter", 1, 1), "p")), "extraction_id", "full_outer")
    others = F.map_filter("p", lambda k, _: ~F.coalesce(F.map_contains_key("v", k), F.lit(False)))
    return both.select("extraction_id", F.when(F.col("v").isNull(), F.col("p")).when(F.col("p").isNull(), F.col("v")).otherwise(F.map_concat("v", others)).alias("symbols"))


def with_dims(rows: DataFrame) -> DataFrame:
    """``rows`` with dim, the exponents of their unit; each distinct unit is read once, as rows share few."""
    rows = rows.withColumn("unit", F.coalesce("unit", F.lit("")))
    return rows.join(rows.select("unit").distinct().withColumn("dim", parse_unit("unit")), "unit")


def dimension_map(variables: DataFrame, parameters: DataFrame) -> DataFrame:
    """(extraction_id, dims): map from symbol, and its lower case where that is free, to its dimension; units that cannot be read are left out.

    A variable's own name comes before another's lower case, both before parameters; the last of equal variables and the
    first of equal parameters count.
    """
    part = lambda df, rank: df.where(F.coalesce("symbol", F.lit("")) != "").select("extraction_id", "symbol", "unit", F.lit(rank).alias("rank"), F.col("ordinal").cast("long").alias("ordinal"))
    rows = with_dims(part(variables, 0).unionByName(part(parameters, 1)))
    by = lambda r, o, e: F.struct(r.alias("r"), o.alias("o"), F.lit(e).alias("e"))
    own = F.struct(F.col("symbol").alias("key"), F.when(F.col("rank") == 0, by(F.lit(0), -F.col("ordinal"), 0)).otherwise(by(F.lit(2), F.col("ordinal"), 0)).alias("by"))
    alias = F.when(F.lower("symbol") != F.col("symbol"), F.struct(F.lower("symbol").alias("key"), by(F.col("rank") + 1, F.col("ordinal"), 1).alias("by")))
    # both names of a row are exploded together, so that its unit is read once
    keys = rows.select("extraction_id", "dim", F.explode(F.array_compact(F.array(own, alias))).alias("k")).where(F.col("dim").isNotNull())
    first = keys.groupBy("extraction_id", F.col("k.key").alias("key")).agg(F.min_by("dim", "k.by").alias("dim"))
    return first.groupBy("extraction_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "dim"))).alias("dims"))


def formal(equations: DataFrame, dims: DataFrame) -> DataFrame:
    """(extraction_id, ordinal, pattern, parsed, matches, lhs, issues) of each equation: the first shape that fits decides.

    The text is the LaTeX, or the description if that is blank. ``matches`` is null where it cannot be told.
    """
    text = F.when(has_text("latex"), trim_all("latex")).otherwise(trim_all(F.coalesce("description", F.lit(""))))
    rows = equations.select("extraction_id", "ordinal", normal_equation(text).alias("t")).join(unsent(dims), "extraction_id", "left")
    d = F.coalesce("dims", F.expr("map()").cast(f"map<string,{DIM}>"))
    rows = rows.withColumns({"d": d, "monod": matched(F.col("t"), MONOD, 5), "ode": matched(F.col("t"), ODE, 1), "bio": F.coalesce(matched(F.col("t"), BIOMASS, 3), matched(F.col("t"), BIOMASS_APART, 3)), "y": matched(F.col("t"), YIELD, 1)})
    at = lambda c: F.try_element_at("d", c)
    time = F.coalesce(at(F.lit("t")), dim(t=1))
    none = F.array().cast("array<string>")
    say = lambda cond, *text: F.when(cond, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in text)))
    issues = lambda *found: F.array_compact(F.array(*found))
    out = lambda pattern, matches, lhs, found: F.struct(F.lit(pattern).alias("pattern"), F.lit(True).alias("parsed"), matches.cast("boolean").alias("matches"), label(lhs).alias("lhs"), found.alias("issues"))

    m = F.col("monod")
    half = F.when(m[3] == m[2], m[4]).otherwise(m[3])
    names = [m[0], m[1], m[2], half]
    lost = issues(*(say(at(n).isNull(), n, " has no dimension") for n in names))
    unequal = issues(say(~same_dim(at(m[2]), at(half)), "substrate and half saturation differ"), say(~same_dim(at(m[0]), at(m[1])), "rate and greatest rate differ"))
    monod = F.when(m.isNotNull(), F.when(F.size(lost) > 0, out("monod", F.lit(None), F.lit(None).cast(DIM), lost)).otherwise(out("monod", F.size(unequal) == 0, at(m[0]), unequal)))

    b = F.col("bio")
    lost = issues(say(at(b[0]).isNull(), b[0], " has no dimension"), say(at(b[1]).isNull(), b[1], " has no dimension"), say(at(b[2]).isNull(), b[2], " has no dimension"))
    wrong = issues(*(say(at(b[k]).isNotNull() & ~is_dim(at(b[k]), *RATE), b[k], " is no rate") for k in (1, 2)))
    unknown = at(b[0]).isNull() | (at(b[1]).isNull() & at(b[2]).isNull())
    lhs = minus(at(b[0]), time)
    biomass = F.when(b.isNotNull() & F.col("ode").isNotNull(), F.when(unknown, out("biomass", F.lit(None), lhs, lost)).otherwise(out("biomass", F.size(F.concat(lost, wrong)) == 0, lhs, F.concat(lost, wrong))))

    s, y = F.col("ode")[0], F.col("y")[0]
    dilution = F.coalesce(at(F.lit("D")), at(F.lit("d")))
    found = issues(say(at(s).isNull(), s, " has no dimension"), say(at(y).isNull(), y, " has no dimension"), say(at(y).isNotNull() & ~is_dim(at(y)), y, " is no ratio"), say(dilution.isNotNull() & ~is_dim(dilution, *RATE), "D is no rate"))
    substrate = F.when(F.col("ode").isNotNull() & F.regexp_like("t", F.lit(YIELD_GATE)) & F.col("y").isNotNull(), out("substrate", F.when(F.size(found) == 0, True), minus(at(s), time), found))

    k = F.coalesce(*(at(F.lit(n)) for n in ("kLa", "kla", "k_La", "k_la", "KLa", "Kla")))
    found = issues(say(k.isNull(), "kLa has no dimension"), say(k.isNotNull() & ~is_dim(k, *RATE), "kLa is no rate"))
    gas = F.when(F.regexp_like("t", F.lit(KLA)), out("gas_liquid", F.when(k.isNotNull(), F.size(found) == 0), dim(m=1, v=-1, t=-1), found))

    found = issues(say(at(s).isNull(), s, " has no dimension"))
    plain = F.when(F.col("ode").isNotNull(), out("ode", F.lit(None), minus(at(s), time), found))
    nothing = F.struct(F.lit(None).cast("string").alias("pattern"), F.lit(False).alias("parsed"), F.lit(None).cast("boolean").alias("matches"), F.lit(None).cast("string").alias("lhs"), none.alias("issues"))
    return rows.select("extraction_id", "ordinal", F.coalesce(monod, biomass, substrate, gas, plain, nothing).alias("r")).select("extraction_id", "ordinal", "r.*")


def formal_status(cards: DataFrame, results: DataFrame) -> DataFrame:
    """(extraction_id, status): unavailable without a parsed equation, fail with a mismatch, warning with issues, else pass."""
    by = results.groupBy("extraction_id").agg(F.bool_or("parsed").alias("any"), F.bool_or(F.coalesce(~F.col("matches"), F.lit(False))).alias("bad"), F.bool_or(F.size("issues") > 0).alias("unsure"))
    status = F.when(~F.coalesce("any", F.lit(False)), "unavailable").when(F.col("bad"), "fail").when(F.col("unsure"), "warning").otherwise("pass")
    return cards.select("extraction_id").join(unsent(by), "extraction_id", "left").select("extraction_id", status.alias("status"))


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.regexp_like(c, F.lit(p)) for p in patterns))


def time_scale(c: Column) -> Column:
    """The time unit a unit divides by, in one spelling, or null."""
    found = F.regexp_extract(F.lower(c), rf"/\s*(h|hr|hrs|hours?|min|mins|minutes?|d|days?|s|secs?|seconds?){_E}", 1)
    spelt = {"hour": "^h", "minute": "^m", "day": "^d", "second": "^s"}
    return F.coalesce(*(F.when(found.rlike(p), name) for name, p in spelt.items()))


def heuristic(cards: DataFrame, equations: DataFrame, variables: DataFrame, parameters: DataFrame) -> DataFrame:
    """(extraction_id, severity, rule, subject): what looks wrong with units and symbols, under nine rules.

    ``cards`` has extraction_id and corpus, the card's text. Equations have latex, description and, where the provider
    listed them, variables_involved (null where it did not).
    """
    row = lambda df, severity, rule, subject: df.select("extraction_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))
    symbols = variables.select("extraction_id", F.col("symbol").alias("s")).union(parameters.select("extraction_id", "symbol")).where(F.coalesce("s", F.lit("")) != "")
    listed = equations.where(F.col("variables_involved").isNotNull())
    # symbols are told apart by grouping two tables as one, since rows dealt by card need no exchange for that; a join by card and symbol would deal them anew
    together = lambda a, b: a.select("extraction_id", "s", F.lit(True).alias("a")).union(b.select("extraction_id", "s", F.lit(False))).groupBy("extraction_id", "s").agg(F.bool_or("a").alias("in_a"), F.bool_or(~F.col("a")).alias("in_b"))
    undefined = lambda df: together(df, symbols).where("in_a AND NOT in_b").select("extraction_id", "s")
    named = undefined(listed.select("extraction_id", F.explode("variables_involved").alias("s")).where(F.trim("s") != ""))
    short = (F.length("s") > 1) | F.col("s").isin("X", "S", "D")
    written = undefined(equations.select("extraction_id", F.explode(identifiers("latex", LATEX_WORDS)).alias("s")).where(short & (F.col("s") != "mu")))
    states = equations.select("extraction_id", F.explode(F.regexp_extract_all(F.coalesce("latex", F.lit("")), F.lit(r"d\[?([A-Za-z_][A-Za-z0-9_]*)\]?\s*/\s*dt(?![A-Za-z0-9_])"), F.lit(1))).alias("s")).distinct()
    units = variables.select("extraction_id", F.col("symbol").alias("s"), "unit").union(parameters.select("extraction_id", "symbol", "unit"))
    bare = units.where(~has_text("unit")).select("extraction_id", "s").distinct()
    conventions = []
    classed = units.where(has_text("unit")).withColumn("class", F.coalesce(*(F.when(_any(F.col("s"), p), F.lit(k)) for k, p in SYMBOL_CLASSES.items())))
    for kind, shapes in UNIT_SHAPES.items():
        conventions.append(row(classed.where((F.col("class") == kind) & ~_any(F.lower(trim_all("unit")), shapes)), "medium", f"{kind}_unit", F.col("s")))
    scales = units.select("extraction_id", time_scale(F.coalesce("unit", F.lit(""))).alias("scale")).where(F.col("scale").isNotNull())
    mixed = scales.groupBy("extraction_id").agg(F.array_join(F.array_sort(F.collect_set("scale")), ", ").alias("scales"), F.countDistinct("scale").alias("n")).where("n > 1")
    gas = cards.where(reduce(lambda a, b: a | b, (F.contains(F.lower("corpus"), F.lit(w)) for w in GAS_WORDS)))
    kla = symbols.where(F.lower("s").isin("kla", "k_la", "kl_a")).select("extraction_id")
    texts = equations.groupBy("extraction_id").agg(F.array_join(F.collect_list(F.concat_ws(" ", "latex", "description")), " ").alias("all_text"))
    unused = parameters.where(F.coalesce("symbol", F.lit("")) != "").join(texts, "extraction_id").where(~F.coalesce(has_word("all_text", "symbol"), F.lit(False)))
    parts = [
        row(variables.where((F.col("role") == "state") & ~has_text("unit")), "high", "state_without_unit", F.col("symbol")),
        row(parameters.where(~has_text("unit")), "medium", "parameter_without_unit", F.col("symbol")),
        row(listed.where(F.size("variables_involved") == 0), "low", "no_symbols_listed", F.col("ordinal")),
        row(named, "high", "listed_symbol_undefined", F.col("s")),
        row(together(states, bare).where("in_a AND in_b"), "medium", "derivative_without_unit", F.col("s")),
        row(written, "medium", "symbol_undefined", F.col("s")),
        *conventions,
        row(mixed, "medium", "mixed_time_scales", F.col("scales")),
        row(gas.join(kla, "extraction_id", "left_anti"), "medium", "gas_without_kla", F.lit(None)),
        row(unused, "low", "parameter_unused", F.col("symbol")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def status(cards: DataFrame, findings: DataFrame) -> DataFrame:
    """(extraction_id, high, medium, low, status): any high fails, any medium warns."""
    n = findings.groupBy("extraction_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")))
    out = cards.select("extraction_id").join(n, "extraction_id", "left")
    out = out.withColumns({s: F.coalesce(s, F.lit(0)) for s in ("high", "medium", "low")})
    return out.withColumn("status", F.when(F.col("high") > 0, "fail").when(F.col("medium") > 0, "warning").otherwise("pass"))


def ranked(findings: DataFrame, order: dict[str, int]) -> DataFrame:
    """``findings`` with place: by severity, then rule and subject."""
    rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(k)) for s, k in order.items()))
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("extraction_id").orderBy(rank, "rule", "subject")))
