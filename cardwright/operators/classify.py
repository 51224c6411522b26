"""Keyword classification of documents into model types, and how much of a type's template a card covers.

The rules become one column expression a type: a single scan without join, inside generated code.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwright.functions.text import hits, round_half_up

#: (keyword, weight) by model type, in the order in which ties are decided. Fixed values.
RULES: dict[str, list[tuple[str, int]]] = {
    "chemostat": [
        ("chemostat", 3), ("continuous culture", 3), ("cstbr", 3), ("dilution rate", 3), ("washout", 2), ("wash-out", 2), ("monod", 2), ("sin", 1),
        ("s_in", 1), ("influent", 2), ("effluent", 2), ("steady state", 1), ("continuous stirred tank bioreactor", 3), ("continuous fermentation", 2),
        ("feed concentration", 1), ("specific growth rate", 1), ("biomass washout", 3), ("dilution", 1),
    ],
    "batch_reactor": [
        ("batch reactor", 3), ("batch culture", 3), ("batch fermentation", 3), ("batch process", 2), ("closed system", 2), ("no inflow", 2),
        ("no outflow", 2), ("initial concentration", 2), ("initial biomass", 2), ("substrate depletion", 2), ("inoculum", 1), ("inoculation", 1),
        ("batch growth", 2),
    ],
    "fed_batch": [
        ("fed-batch", 3), ("fed batch", 3), ("feeding strategy", 3), ("feed rate", 2), ("feed flow", 2), ("volume change", 2), ("dv/dt", 3),
        ("variable volume", 3), ("semi-batch", 2), ("exponential feed", 3), ("pulse feed", 2), ("substrate feeding", 2), ("intermittent feeding", 2),
        ("bolus", 2),
    ],
    "cstr": [
        ("cstr", 3), ("continuously stirred tank reactor", 3), ("continuous stirred tank reactor", 3), ("conversion", 1), ("selectivity", 1),
        ("damköhler", 3), ("damkohler", 3), ("activation energy", 2), ("arrhenius", 3), ("heat of reaction", 2), ("exothermic", 2),
        ("endothermic", 2), ("rate constant", 1), ("pre-exponential", 2), ("residence time", 2), ("elementary reaction", 2), ("rate law", 1),
        ("chemical reactor", 2),
    ],
    "gas_liquid_transfer": [
        ("kla", 3), ("k_la", 3), ("oxygen transfer", 3), ("dissolved oxygen", 3), ("volumetric mass transfer", 3), ("otr", 2), ("our", 2),
        ("aeration", 2), ("saturation concentration", 2), ("henry", 2), ("sparger", 2), ("gas-liquid", 2), ("gas liquid", 2), ("bubble column", 2),
        ("airflow", 1), ("oxygen demand", 2), ("do probe", 2), ("mass transfer coefficient", 2),
    ],
    "microalgae_pbr": [
        ("microalgae", 3), ("photobioreactor", 3), ("pbr", 2), ("irradiance", 3), ("par", 2), ("photosynthesis", 3), ("chlorophyll", 2),
        ("light intensity", 2), ("carbon fixation", 2), ("co2 supply", 1), ("biomass productivity", 2), ("algae", 2), ("cyanobacteria", 2),
        ("photoinhibition", 3), ("haldane", 2), ("light saturation", 3), ("growth medium", 1), ("pruvost", 3),
    ],
}
#: What hits in each group of fields are worth. Fixed values.
FIELD_WEIGHTS = {"source_text": 1, "title_domain": 3, "names": 2, "symbols": 1}
MOST_HITS, HALF = 3, 5

#: (symbol, unit, required, aliases) of the variables and parameters a type's card should have. Fixed values.
_T = ("t", "h", True, ("t", "time"))
TEMPLATES: dict[str, dict[str, list[tuple[str, str, bool, tuple[str, ...]]]]] = {
    "chemostat": {
        "variables": [("X", "g/L", True, ("X", "Cx", "biomass")), ("S", "g/L", True, ("S", "Cs", "substrate", "glucose")), _T],
        "parameters": [("D", "1/h", True, ("D", "dilution_rate", "D_value")), ("Sin", "g/L", True, ("Sin", "S_in", "Sf", "s_feed")), ("μmax", "1/h", True, ("μmax", "mu_max", "umax", "mumax")), ("Ks", "g/L", True, ("Ks", "K_s", "Km")), ("Yxs", "g/g", True, ("Yxs", "Y_xs", "Y", "yield"))],
    },
    "batch_reactor": {
        "variables": [("X", "g/L", True, ("X", "Cx")), ("S", "g/L", True, ("S", "Cs")), ("t", "h", True, ())],
        "parameters": [("X0", "g/L", True, ("X0", "X(0)", "X_0")), ("S0", "g/L", True, ("S0", "S(0)", "S_0")), ("μmax", "1/h", True, ("μmax", "mu_max")), ("Ks", "g/L", True, ("Ks", "K_s")), ("Yxs", "g/g", True, ("Yxs", "Y"))],
    },
    "fed_batch": {
        "variables": [("X", "g/L", True, ()), ("S", "g/L", True, ()), ("V", "L", True, ()), ("t", "h", True, ())],
        "parameters": [("F", "L/h", True, ("F", "Fin", "F_feed")), ("Sin", "g/L", True, ("Sin", "S_in")), ("μmax", "1/h", True, ()), ("Yxs", "g/g", True, ()), ("V0", "L", False, ())],
    },
    "cstr": {
        "variables": [("Ca", "mol/L", True, ("Ca", "C_A", "C")), ("T", "K", False, ("T", "Temp")), ("t", "s", True, ())],
        "parameters": [("τ", "s", True, ("tau", "τ", "theta")), ("k0", "1/s (or units of rate)", False, ("k0", "A", "k_0")), ("Ea", "J/mol", False, ("Ea", "E_a", "activation_energy")), ("Ca0", "mol/L", True, ("Ca0", "C_A0", "Cin")), ("ΔHr", "J/mol", False, ("ΔHr", "dHr", "Hr"))],
    },
    "gas_liquid_transfer": {
        "variables": [("CL", "g/L", True, ("CL", "C_L", "DO", "C_O2")), ("t", "h", True, ())],
        "parameters": [("kLa", "1/h", True, ("kLa", "k_La", "KLa")), ("C*", "g/L", True, ("Cstar", "C*", "CL_sat", "Csat")), ("OUR", "g/L/h", False, ("OUR", "qO2")), ("qO2", "g/(g·h)", False, ("qO2", "q_O2"))],
    },
    "microalgae_pbr": {
        "variables": [("X", "g/L", True, ("X", "Cx", "biomass")), ("t", "d", True, ())],
        "parameters": [("I", "μmol/m²/s", True, ("I", "I0", "irradiance", "PAR")), ("μmax", "1/d", True, ("μmax", "mu_max")), ("KI", "μmol/m²/s", True, ("KI", "K_I", "Ks_light")), ("KIi", "μmol/m²/s", False, ("KIi", "Ki", "KI_inhib")), ("D", "1/d", False, ("D",))],
    },
    "generic_ode": {"variables": [], "parameters": []},
}

Rules = Mapping[str, Sequence[tuple[str, int]]]


def rules() -> Rules:
    return RULES


def _of_type(fields: Mapping[str, tuple[Column, int]], keywords: Sequence[tuple[str, int]]) -> tuple[Column, Column]:
    """(score, array of matched keywords, nulls for the others)."""
    score, matched = F.lit(0), []
    for keyword, weight in keywords:
        n = {name: hits(text, keyword) for name, (text, _) in fields.items()}
        for name, (_, worth) in fields.items():
            score = score + F.least(n[name], F.lit(MOST_HITS)) * (weight * worth)
        matched.append(F.when(F.greatest(*n.values()) > 0 if len(n) > 1 else next(iter(n.values())) > 0, F.lit(keyword)))
    return score, F.array(*matched)


def classify(docs: DataFrame, fields: Mapping[str, tuple[Column, int]], table: Rules | None = None, fallback: str = "generic_ode") -> DataFrame:
    """``docs`` with model_type, confidence, matched_keywords and a map of scores over 0.

    ``fields`` maps names to (text column, worth of a hit). Each keyword counts at most three places a field. The type with
    the most points wins, the earlier in ``table`` of equal ones; without points it is ``fallback`` with confidence 0. The
    confidence is s / (s + 5), rounded to two digits. Matched keywords are those of all types, sorted.
    """
    table = table or RULES
    folded = {name: (F.col(f"_{name}"), worth) for name, (_, worth) in fields.items()}
    out = docs.withColumns({f"_{name}": F.lower(F.coalesce(text, F.lit(""))) for name, (text, _) in fields.items()})
    found = {kind: _of_type(folded, keywords) for kind, keywords in table.items()}
    # a column a type keeps the generated methods small
    out = out.withColumns({f"_score_{kind}": score for kind, (score, _) in found.items()} | {f"_found_{kind}": words for kind, (_, words) in found.items()})
    kinds = list(table)
    best = F.greatest(*(F.col(f"_score_{k}") for k in kinds)) if len(kinds) > 1 else F.col(f"_score_{kinds[0]}")
    winner = F.coalesce(*(F.when((F.col(f"_score_{k}") == best) & (best > 0), F.lit(k)) for k in kinds), F.lit(fallback))
    words = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array(*(F.col(f"_found_{k}") for k in kinds))))))
    scores = F.map_filter(F.create_map(*(x for k in kinds for x in (F.lit(k), F.col(f"_score_{k}")))), lambda _, v: v > 0)
    out = out.withColumns({"model_type": winner, "confidence": round_half_up(best.cast("double") / (best + HALF), 2), "matched_keywords": words, "scores": scores})
    return out.drop(*(c for c in out.columns if c.startswith(("_score_", "_found_"))), *(f"_{name}" for name in fields))


def classify_cards(cards: DataFrame) -> DataFrame:
    """``classify`` over (source_text, title, domain, variable_names, variable_symbols, parameter_names, parameter_symbols)."""
    joined = lambda a, b: F.array_join(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), " ")
    fields = {
        "source_text": F.col("source_text"), "title_domain": F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("domain", F.lit(""))),
        "names": joined("variable_names", "parameter_names"), "symbols": joined("variable_symbols", "parameter_symbols"),
    }
    return classify(cards, {k: (v, FIELD_WEIGHTS[k]) for k, v in fields.items()})


def template_rows(spark) -> DataFrame:
    """(model_type, part, ordinal, symbol, unit, required, targets): the templates as a small table, its size fixed by TEMPLATES."""
    rows = [(kind, part, i, s, u, r, sorted({s.lower(), *(a.lower() for a in aliases)})) for kind, t in TEMPLATES.items() for part, items in t.items() for i, (s, u, r, aliases) in enumerate(items)]
    return spark.createDataFrame(rows, "model_type string, part string, ordinal int, symbol string, unit string, required boolean, targets array<string>")


def coverage(cards: DataFrame, items: DataFrame) -> DataFrame:
    """(extraction_id, part, ordinal, symbol, required, present): which items of its type's template a card has.

    ``cards`` has extraction_id and model_type; ``items`` has extraction_id, part, symbol and name. An item is present if a
    symbol equals one of its targets, or a name contains one, case folded.
    """
    expected = cards.select("extraction_id", "model_type").join(F.broadcast(template_rows(cards.sparkSession)), "model_type")
    own = items.groupBy("extraction_id", "part").agg(F.collect_set(F.lower(F.coalesce("symbol", F.lit("")))).alias("symbols"), F.collect_set(F.lower(F.coalesce("name", F.lit("")))).alias("names"))
    joined = expected.join(own, ["extraction_id", "part"], "left")
    present = F.exists("targets", lambda t: F.array_contains("symbols", t) | F.exists("names", lambda n: F.contains(n, t)))
    return joined.select("extraction_id", "part", "ordinal", "symbol", "required", F.coalesce(present, F.lit(False)).alias("present"))


def missing_required(covered: DataFrame) -> DataFrame:
    """(extraction_id, missing_variables, missing_parameters): required items that are absent."""
    absent = lambda part: F.count_if((F.col("part") == part) & F.col("required") & ~F.col("present"))
    return covered.groupBy("extraction_id").agg(absent("variables").alias("missing_variables"), absent("parameters").alias("missing_parameters"))
