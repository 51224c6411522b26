"""Equations matched to code templates, by shape and by the symbols that a card defines; all as columns."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwright.functions.text import has_text, trim_all
from cardwright.functions.units import matched, normal_equation
from cardwright.operators.units import KLA, MONOD, YIELD, symbol_map
from cardwright.sources.work import unsent

_W = "[a-z_][A-Za-z0-9_]*"
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Shapes on normal texts, without white space inside a derivative. Fixed values.
BIOMASS = rf"d({_W})/dt\s*=\s*\(?\s*({_W})\s*-\s*({_W})\s*\)?\s*\*?\s*\1"
BIOMASS_APART = rf"d({_W})/dt\s*=\s*({_W})\s*\*\s*\1\s*-\s*({_W})\s*\*\s*\1"
ODE = rf"d({_W})/dt\s*="
FEED = rf"{_B}(s(?:in|0|_?in|_?0|feed|f)?){_E}"
UPTAKE = rf"/([\sA-Za-z0-9_]+)\)\s*\*\s*({_W})\s*\*\s*({_W})"
DECAY = rf"d({_W})/dt\s*=\s*-\s*({_W})\s*\*\s*\1"
GAS_ODE = rf"d({_W})/dt\s*=\s*({_W})\s*\*\s*\(\s*({_W})\s*-\s*\1\s*\)"
GAS = rf"^({_W})\s*=\s*({_W})\s*\*\s*\(\s*({_W})\s*-\s*({_W})\s*\)"

_RESULT = "struct<kind:string,template:string,state:string,code:string,missing:array<string>>"


def match(equations: DataFrame, variables: DataFrame, parameters: DataFrame) -> DataFrame:
    """(extraction_id, ordinal, kind, template, state, code, missing, runnable) of each equation.

    kind is matched (an algebraic template), derivative, unmatched, or repeated: a later derivative of a state that has one
    counts as neither. Symbols are looked up in lower case and written as the card writes them. Code is null for a
    derivative with missing symbols, and says what is missing in a matched equation.
    """
    text = F.when(has_text("latex"), trim_all("latex")).otherwise(trim_all(F.coalesce("description", F.lit(""))))
    others = variables.where("role = 'state'").groupBy("extraction_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.lower("symbol").alias("s")))), lambda x: x["s"]).alias("states"))
    rows = equations.select("extraction_id", "ordinal", normal_equation(text).alias("t")).join(unsent(symbol_map(variables, parameters, lower=True)), "extraction_id", "left").join(unsent(others), "extraction_id", "left")
    shapes = {"monod": (MONOD + r"\s*$", 5), "bio1": (BIOMASS, 3), "bio2": (BIOMASS_APART, 3), "ode": (ODE, 1), "y": (YIELD, 1), "feed": (FEED, 1), "uptake": (UPTAKE, 3), "decay": (DECAY, 2), "gas_ode": (GAS_ODE, 3), "gas": (GAS, 4)}
    rows = rows.withColumns({name: matched(F.col("t"), pattern, n) for name, (pattern, n) in shapes.items()})
    entry = lambda c: F.try_element_at("symbols", c)
    has = lambda c: F.coalesce(entry(c).isNotNull(), F.lit(False))
    own = lambda c: F.coalesce(entry(c)["symbol"], c)
    lacking = lambda *names: F.array_compact(F.array(*(F.when(n.isNotNull() & ~has(n), own(n)) for n in names)))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    def result(kind: str, template: str, state: Column | None, code: Column, missing: Column) -> Column:
        if kind == "matched":
            code = F.when(F.size(missing) > 0, F.concat(code, F.lit("  # TODO: missing symbols: "), F.array_join(missing, ", "))).otherwise(code)
        else:
            code = F.when(F.size(missing) == 0, code)
        return F.struct(F.lit(kind).alias("kind"), F.lit(template).alias("template"), (state if state is not None else F.lit(None)).cast("string").alias("state"), code.alias("code"), missing.alias("missing")).cast(_RESULT)

    m = F.col("monod")
    half = F.when(m[3] == m[2], m[4]).otherwise(m[3])
    monod = F.when(m.isNotNull(), result("matched", "monod_kinetics", None, say(own(m[0]), " = ", own(m[1]), " * ", own(m[2]), " / (", own(half), " + ", own(m[2]), ")"), lacking(m[1], m[2], half)))

    b = F.coalesce("bio1", "bio2")
    no_rate = F.when(~has(b[1]) & ~has(b[2]), F.array(own(b[1]), own(b[2]))).otherwise(F.array().cast("array<string>"))
    biomass = F.when(b.isNotNull(), result("derivative", "biomass", own(b[0]), say("d", own(b[0]), "dt = (", own(b[1]), " - ", own(b[2]), ") * ", own(b[0])), F.concat(lacking(b[0]), no_rate)))

    s, y, d = F.col("ode")[0], F.col("y")[0], F.lit("d")
    feed = F.col("feed")[0]
    other = F.try_element_at(F.filter(F.coalesce("states", F.array().cast("array<string>")), lambda x: x != s), F.lit(1))
    mu = F.coalesce(F.col("uptake")[1], F.lit("mu"))
    line = say("d", own(s), "dt = ", own(d), " * (", F.coalesce(own(feed), F.lit("Sin")), " - ", own(s), ") - (1.0 / ", own(y), ") * ", own(mu), " * ", F.coalesce(own(other), F.lit("X")))
    gate = F.col("ode").isNotNull() & F.col("y").isNotNull() & F.regexp_like("t", F.lit(rf"{_B}d{_E}")) & has(d)
    substrate = F.when(gate, result("derivative", "substrate", own(s), line, lacking(s, y, d, feed, other)))

    k = F.col("decay")
    decay = F.when(k.isNotNull(), result("derivative", "first_order_decay", own(k[0]), say("d", own(k[0]), "dt = -", own(k[1]), " * ", own(k[0])), lacking(k[0], k[1])))

    known = F.coalesce(*(F.when(has(F.lit(n)), F.lit(n)) for n in ("kla", "k_la", "kl_a")))
    g, a, is_gas = F.col("gas_ode"), F.col("gas"), F.regexp_like("t", F.lit(KLA))
    rate = F.coalesce(known, g[1])
    gas_ode = F.when(is_gas & g.isNotNull(), result("derivative", "gas_liquid_ode", own(g[0]), say("d", own(g[0]), "dt = ", own(rate), " * (", own(g[2]), " - ", own(g[0]), ")"), lacking(g[0], rate, g[2])))
    rate = F.coalesce(known, a[1])
    gas = F.when(is_gas & a.isNotNull(), result("matched", "gas_liquid_transfer", None, say(own(a[0]), " = ", own(rate), " * (", own(a[2]), " - ", own(a[3]), ")"), lacking(a[0], rate, a[2], a[3])))
    none = F.lit(None).cast("string")
    unmatched = F.struct(F.lit("unmatched").alias("kind"), none.alias("template"), none.alias("state"), none.alias("code"), F.array().cast("array<string>").alias("missing")).cast(_RESULT)
    out = rows.select("extraction_id", "ordinal", F.coalesce(monod, biomass, substrate, decay, gas_ode, gas, unmatched).alias("r")).select("extraction_id", "ordinal", "r.*")
    place = F.row_number().over(Window.partitionBy("extraction_id", "kind", F.lower("state")).orderBy("ordinal"))
    out = out.withColumn("kind", F.when((F.col("kind") == "derivative") & (place > 1), "repeated").otherwise(F.col("kind")))
    return out.withColumn("runnable", F.col("kind").isin("matched", "derivative") & (F.size("missing") == 0))


def status(cards: DataFrame, results: DataFrame) -> DataFrame:
    """(extraction_id, matched, derivatives, unmatched, runnable, status): full if all count and run, scaffold_only without any template, partial with anything that has none or does not run, else full."""
    n = results.where("kind != 'repeated'").groupBy("extraction_id").agg(*(F.count_if(F.col("kind") == k).alias(name) for k, name in (("matched", "matched"), ("derivative", "derivatives"), ("unmatched", "unmatched"))), F.count_if("runnable").alias("runnable"), F.count("*").alias("n"))
    out = cards.select("extraction_id").join(unsent(n), "extraction_id", "left").na.fill(0)
    return out.withColumn("status", F.when(F.col("matched") + F.col("derivatives") == 0, "scaffold_only").when(F.col("runnable") < F.col("n"), "partial").otherwise("full")).drop("n")
