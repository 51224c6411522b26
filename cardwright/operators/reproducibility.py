"""How completely a card describes its model: findings, five sub-scores, the overall score, readiness and next steps."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwright.functions.text import has_value, identifiers, round_half_up
from cardwright.operators.units import LATEX_WORDS
from cardwright.sources.work import unsent

_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Patterns on the lower-case corpus. Fixed values.
TIME = rf"{_B}(time|hour|day|minute|second|t\s*=|d/dt|dxdt){_E}"
TIME_UNIT = rf"{_B}(h{_E}|hr{_E}|hours?{_E}|days?{_E}|min{_E}|seconds?{_E}|s{_E})"
INITIAL = rf"{_B}(initial\s*(condition|value|concentration|biomass|substrate|state|population)|x_?0|s_?0|c_?0|x\(0\)|s\(0\)|at\s*t\s*=\s*0|t0\s*=){_E}"
BOUNDARY = rf"{_B}(boundary|inlet|feed|dilution|influent|input\s*concentration|s_?in{_E}|sin{_E}|c_?in{_E}|cin{_E}){_E}"
KINETICS = rf"{_B}(monod|michaelis|menten|mu_?max|ks{_E}|km{_E}|half.saturation|growth rate){_E}"
KINETIC_SYMBOL = "(?i)mu_?max|mumax|k_?s|k_?m"
YIELD = rf"{_B}(yield|y_?xs|y_?px|y_?po|yield coefficient|stoichiometr){_E}"
GAS = rf"{_B}(oxygen|o2|co2|aeration|gas.transfer|kla|k_la|henry|gas.liquid|dissolved oxygen){_E}"
GAS_SYMBOL = "(?i)kla|k_la|henry|kh|h_cc|alpha|o2"
HENRY = "henry|gas.liquid.equilibrium|h_cc|h_cp"
#: Weights of the overall score. Fixed values.
WEIGHTS = {"equations": 0.25, "parameters": 0.25, "units": 0.20, "initial_conditions": 0.20, "traceability": 0.10}
SEVERITIES = {"critical": 0, "warning": 1, "info": 2}


def corpus(extractions: DataFrame) -> DataFrame:
    """(extraction_id, corpus): the lower-case text that patterns are looked for in; the raw document as it is stored."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return extractions.select(F.col("id").alias("extraction_id"), F.lower(F.concat_ws(" ", text("system_description"), text("problem_statement"), text("ode_template"), F.coalesce("raw_extraction_json", F.lit("{}")))).alias("corpus"))


def _share(cond: Column) -> Column:
    """Aggregate: rounded per cent of rows."""
    return F.when(F.count("*") == 0, 0.0).otherwise(round_half_up(F.count_if(cond) * 100.0 / F.count("*")))


def facts(extractions: DataFrame, equations: DataFrame, variables: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row a card: counts and shares that scores are made of. Children are counted before the join."""
    quoted = has_value("source_quote")
    e = equations.groupBy("extraction_id").agg(F.count("*").alias("n_eq"), _share(has_value("latex")).alias("eq_latex"), _share(has_value("description")).alias("eq_text"), _share(quoted).alias("eq_quote"))
    v = variables.groupBy("extraction_id").agg(F.count("*").alias("n_var"), F.count_if(F.col("role") == "state").alias("n_state"), _share(has_value("unit")).alias("var_unit"), _share(quoted).alias("var_quote"))
    value = has_value(F.col("value").cast("string"))
    p = parameters.groupBy("extraction_id").agg(F.count("*").alias("n_par"), _share(value).alias("par_value"), _share(has_value("unit")).alias("par_unit"), _share(quoted).alias("par_quote"), F.coalesce(F.bool_or(F.regexp_like("symbol", F.lit(KINETIC_SYMBOL))), F.lit(False)).alias("kinetic"), F.coalesce(F.bool_or(F.regexp_like("symbol", F.lit(GAS_SYMBOL))), F.lit(False)).alias("gas_symbol"))
    out = corpus(extractions)
    for part in (e, v, p):
        out = out.join(unsent(part), "extraction_id", "left")
    out = out.na.fill(0).na.fill(False)
    patterns = {"time": TIME, "time_unit": TIME_UNIT, "initial": INITIAL, "boundary": BOUNDARY, "kinetics": KINETICS, "yields": YIELD, "gas": GAS, "henry": HENRY}
    return out.withColumns({f"has_{k}": F.regexp_like("corpus", F.lit(x)) for k, x in patterns.items()})


def scores(known: DataFrame, findings: DataFrame) -> DataFrame:
    """(extraction_id, the five sub-scores, overall, readiness), each from 0 to 100. ``known`` is from ``facts``."""
    capped = lambda c: F.least(F.lit(100.0), round_half_up(c))
    s = {
        "equations": F.when(F.col("n_eq") == 0, 0.0).otherwise(capped(30 + 0.35 * F.col("eq_latex") + 0.20 * F.col("eq_text") + 0.15 * F.col("eq_quote"))),
        "parameters": F.when(F.col("n_par") == 0, 0.0).otherwise(capped(20 + 0.40 * F.col("par_value") + 0.25 * F.col("par_unit") + 0.15 * F.col("par_quote"))),
        "units": F.greatest(F.lit(0.0), capped(0.5 * F.col("var_unit") + 0.5 * F.col("par_unit")) - F.when(F.col("has_time") & ~F.col("has_time_unit"), 10).otherwise(0)),
        "initial_conditions": F.when(F.col("n_var") == 0, 0.0).otherwise(capped(25 + F.when(F.col("has_initial"), 45).otherwise(0) + F.when(F.col("has_boundary"), 30).otherwise(0))),
        # the shares are per cents already, so one quoted row saturates this score
        "traceability": capped(F.col("eq_quote") * 35 + F.col("var_quote") * 30 + F.col("par_quote") * 35),
    }
    out = known.select("extraction_id", *(c.alias(k) for k, c in s.items()))
    out = out.withColumn("overall", round_half_up(reduce(lambda a, b: a + b, (F.col(k) * w for k, w in WEIGHTS.items()))))
    critical = findings.groupBy("extraction_id").agg(F.count_if(F.col("severity") == "critical").alias("criticals"))
    out = out.join(unsent(critical), "extraction_id", "left").na.fill(0, ["criticals"])
    ready = F.when((F.col("overall") >= 75) & (F.col("criticals") == 0), "ready").when((F.col("overall") >= 40) & (F.col("criticals") <= 1), "partial").otherwise("not_ready")
    return out.withColumn("readiness", ready)


def findings(known: DataFrame, extractions: DataFrame, equations: DataFrame, variables: DataFrame, parameters: DataFrame) -> DataFrame:
    """(extraction_id, ord, severity, category, description, blocker): what is missing, in order of severity, then of the rules."""
    parts: list[DataFrame] = []

    def add(rows: DataFrame, severity: str, category: str, text: Column | str, blocker: bool = False) -> None:
        said = F.lit(text) if isinstance(text, str) else text
        parts.append(rows.select("extraction_id", F.lit(len(parts)).alias("ord"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), said.alias("description"), F.lit(blocker).alias("blocker")))

    def names(rows: DataFrame, column: str = "symbol") -> DataFrame:
        return rows.groupBy("extraction_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set(F.coalesce(F.col(column).cast("string"), F.lit("?")))), 1, 8), ", ").alias("names"))

    said = lambda text: F.concat(F.lit(text), F.col("names"))
    has = lambda c: F.col(f"has_{c}")
    add(known.where("n_eq = 0"), "critical", "equations", "no equations")
    add(names(equations.where(~has_value("latex")), "ordinal"), "warning", "equations", said("equations without LaTeX: "))
    add(names(equations.where(~has_value("description")), "ordinal"), "info", "equations", said("equations without description: "))
    add(names(equations.where(~has_value("source_quote")), "ordinal"), "info", "equations", said("equations without quote: "))
    add(known.where("n_par = 0"), "critical", "parameters", "no parameters")
    add(names(parameters.where(~has_value(F.col("value").cast("string")))), "critical", "parameters", said("parameters without value: "), True)
    add(names(parameters.where(~has_value("unit"))), "warning", "parameters", said("parameters without unit: "))
    add(names(parameters.where("confidence = 'low'")), "info", "parameters", said("parameters of low confidence: "))
    add(names(variables.where(~has_value("unit"))), "warning", "units", said("variables without unit: "))
    add(known.where(has("time") & ~has("time_unit")), "warning", "units", "time is mentioned without a unit")
    add(known.where("n_state = 0"), "critical", "initial_conditions", "no state variables")
    add(known.where((F.col("n_var") > 0) & ~has("initial")), "critical", "initial_conditions", "no initial conditions", True)
    add(known.where((F.col("n_var") > 0) & ~has("boundary")), "warning", "initial_conditions", "no boundary or inlet conditions")
    add(known.where(has("kinetics") & ~F.col("kinetic")), "warning", "parameters", "kinetics without their constants")
    add(known.where((F.col("n_eq") > 0) & ~has("yields")), "info", "parameters", "no yield coefficients")
    add(known.where(has("gas") & ~F.col("gas_symbol")), "warning", "parameters", "gas transfer without its parameters")
    add(known.where(has("gas") & has("henry")), "info", "parameters", "Henry's law is mentioned: its form and units are to be checked")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9_]", "")
    known_symbols = variables.select("extraction_id", F.lower("symbol").alias("s")).union(parameters.select("extraction_id", F.lower("symbol")))
    used = equations.select("extraction_id", F.explode(F.coalesce("variables_involved", identifiers("latex", LATEX_WORDS))).alias("w")).select("extraction_id", "w", plain("w").alias("s")).where("s != ''")
    # grouped as one table, since rows dealt by card need no exchange for that; a join by card and symbol would deal them anew
    either = used.unionByName(known_symbols.withColumn("w", F.lit(None).cast("string")).withColumn("defined", F.lit(True)), allowMissingColumns=True)
    undefined = either.groupBy("extraction_id", "s").agg(F.collect_set("w").alias("ws"), F.count("defined").alias("n")).where("n = 0").select("extraction_id", F.explode("ws").alias("w"))
    add(names(undefined, "w"), "warning", "equations", said("symbols that are not defined: "))
    texts = equations.groupBy("extraction_id").agg(F.lower(F.array_join(F.collect_list(F.concat_ws(" ", "latex", "description")), " ")).alias("all_text"))
    absent = lambda rows: names(rows.where(F.coalesce("symbol", F.lit("")) != "").join(unsent(texts), "extraction_id").where(~F.contains("all_text", F.lower("symbol"))))
    add(absent(parameters), "info", "parameters", said("parameters in no equation: "))
    add(absent(variables.where("role = 'state'")), "warning", "equations", said("states in no equation: "))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    # what the provider itself listed as missing, unless something already says so
    listed = extractions.select(F.col("id").alias("extraction_id"), F.posexplode(F.from_json(F.get_json_object("raw_extraction_json", "$.model_card.missing_information"), "array<string>")).alias("k", "item")).where(F.trim("item") != "")
    there = out.groupBy("extraction_id").agg(F.collect_list(F.lower("description")).alias("said"))
    listed = listed.join(unsent(there), "extraction_id", "left").where(~F.coalesce(F.exists("said", lambda d: F.contains(d, F.substring(F.lower("item"), 1, 30))), F.lit(False)))
    out = out.unionByName(listed.select("extraction_id", (F.lit(len(parts)) + F.col("k")).alias("ord"), F.lit("warning").alias("severity"), F.lit("provider").alias("category"), F.col("item").alias("description"), F.lit(False).alias("blocker")))
    rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(k)) for s, k in SEVERITIES.items()))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("extraction_id").orderBy(rank, "ord")))


def next_steps(scored: DataFrame, known: DataFrame) -> DataFrame:
    """(extraction_id, steps): what to do about low sub-scores."""
    low = lambda c, least, text: F.when(F.col(c) < least, F.lit(text))
    steps = F.array_compact(F.array(
        low("equations", 60, "Write all equations in LaTeX and describe them."), low("parameters", 60, "Add values and units of parameters."), low("units", 60, "Add units of all variables and parameters."),
        low("initial_conditions", 60, "State initial and boundary conditions."), low("traceability", 50, "Quote the source of each item."), F.when(F.col("has_gas"), F.lit("Check the gas transfer's parameters.")),
    ))
    out = scored.join(unsent(known.select("extraction_id", "has_gas")), "extraction_id")
    return out.select("extraction_id", F.when(F.size(steps) == 0, F.array(F.lit("Simulate the model and compare it with data."))).otherwise(steps).alias("steps"))


#: Columns that scores read, with their types; a card's tables may lack some.
_READ = {
    "equations": {"latex": "string", "description": "string", "source_quote": "string", "variables_involved": "array<string>"}, "variables": {"unit": "string", "role": "string", "source_quote": "string"},
    "parameters": {"unit": "string", "confidence": "string", "source_quote": "string"}, "extractions": dict.fromkeys(("system_description", "problem_statement", "ode_template", "raw_extraction_json"), "string"),
}


def report(extractions: DataFrame, equations: DataFrame, variables: DataFrame, parameters: DataFrame) -> DataFrame:
    """(extraction_id, report): a card's scores, readiness, findings and next steps as JSON; ``extractions`` has id and, where there are any, the texts that ``corpus`` reads."""
    full = lambda df, name: df.withColumns({c: F.lit(None).cast(t) for c, t in _READ[name].items() if c not in df.columns})
    e, tables = full(extractions, "extractions"), [full(df, name) for df, name in ((equations, "equations"), (variables, "variables"), (parameters, "parameters"))]
    known = facts(e, *tables)
    found = findings(known, e, *tables)
    scored = scores(known, found)
    listed = found.groupBy("extraction_id").agg(F.array_sort(F.collect_list(F.struct("place", "severity", "category", "description", "blocker"))).alias("findings"))
    out = scored.join(unsent(next_steps(scored, known)), "extraction_id").join(unsent(listed), "extraction_id", "left")
    shown = F.transform(F.coalesce("findings", F.array().cast("array<struct<place:int,severity:string,category:string,description:string,blocker:boolean>>")), lambda x: x.dropFields("place"))
    return out.select("extraction_id", F.to_json(F.struct("overall", "readiness", F.struct(*WEIGHTS).alias("scores"), shown.alias("findings"), F.col("steps").alias("next_steps"))).alias("report"))
