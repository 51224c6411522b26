"""From source texts to rows: providers, JSON repair, validation and normalisation of extraction documents."""

import json
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwright.functions.text import SPACES, let, capped, first_line, has_text, parse_number, trim_all
from cardwright.sources.tables import EXTRACTION

#: Fewest characters of a trimmed source.
LEAST = 30
ROLES = {"state": "state", "input": "input", "output": "output", "control": "input", "parameter": "input"}


def guarded(docs: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): blank sources and those under 30 characters are rejected with 400 and a reason."""
    t = F.coalesce(text, F.lit(""))
    # from the first character that is no space to another one LEAST - 1 places on or later: long texts are not read to their end
    enough = F.regexp_like(t, F.lit(f"(?s)^[{SPACES}]*+[^{SPACES}].{{{LEAST - 2},}}?[^{SPACES}]"))
    bad = docs.where(~enough).withColumn("reason", F.when(trim_all(t) == "", "the source is empty").otherwise("the source is too short"))
    return docs.where(enough), bad.withColumn("status_code", F.lit(400))


def choose_provider(named: str | None, available: Mapping[str, bool]) -> str:
    """The provider to use: the named one if available; a named openai or gemini without its key is an error; otherwise the first available, in the end mock."""
    if named in ("openai", "gemini") and not available.get(named):
        raise ValueError(f"{named} is not configured")
    if named == "mock" or named and available.get(named):
        return named
    return next((p for p in ("openai", "gemini", "ollama") if available.get(p)), "mock")


def ask(docs: DataFrame, provider: Callable[[str], object], key: str = "id", text: str = "content") -> DataFrame:
    """(key, raw, error): the provider's answer to each text, as text; failures become rows with an error and 502 beside the others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for t in frame[text]:
                try:
                    a = provider(t)
                    answers.append(a if isinstance(a, str) else json.dumps(a, ensure_ascii=False))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a provider may fail in any way
                    answers.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({key: frame[key], "raw": answers, "error": errors})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, raw string, error string").withColumn("status_code", F.when(F.col("error").isNotNull(), 502))


def mock(docs: DataFrame, text: str = "content") -> DataFrame:
    """``docs`` with ``raw``: the fixed document of the built-in provider, its title taken from the text's first line; columns only."""
    title = F.coalesce(capped(first_line(text)), F.lit("Untitled model"))
    item = lambda **f: F.struct(*(F.lit(v).alias(k) for k, v in f.items()))
    said = lambda what, confidence: {"source_context": f"(mock) {what}", "confidence": confidence}
    fixed = F.struct(
        title.alias("paper_title_or_topic"), F.lit("Generic dynamic system (mock)").alias("system_type"), F.lit("A process whose state changes over time; made without reading the source.").alias("process_description"),
        F.array(item(symbol="x", name="Lumped state", meaning="The one state of the system.", unit="—", role="state", **said("the one state", "low")), item(symbol="t", name="Time", meaning="Independent variable.", unit="s", role="input", **said("independent variable", "high"))).alias("state_variables"),
        F.array(item(symbol="k", name="Rate constant", value="0.1", unit="1/s", **said("a default rate", "low"))).alias("parameters"),
        F.array(F.struct(F.lit("(1)").alias("label"), F.lit("\\frac{dx}{dt} = -k\\, x").alias("equation_latex"), F.lit("dx/dt = -k * x").alias("equation_plaintext"), F.lit("First-order decay of the state.").alias("meaning"), F.array(F.lit("x"), F.lit("t"), F.lit("k")).alias("variables_involved"), F.lit("(mock) first-order kinetics").alias("source_context"), F.lit("low").alias("confidence"))).alias("equations"),
        F.array(item(assumption="The system is lumped and well mixed.", source_context="(mock)", confidence="medium"), item(assumption="The temperature is constant.", source_context="(mock)", confidence="medium")).alias("assumptions"),
        F.array(item(limitation="Made by the built-in provider; configure another one for a real extraction.", source_context="(mock)", confidence="high")).alias("limitations"),
        F.struct(F.concat(F.lit('Mock extraction for "'), title, F.lit('".')).alias("short_summary"), F.lit("Lumped ODE").alias("model_type"), F.array(F.lit("t")).alias("inputs"), F.array(F.lit("x")).alias("outputs"), F.array().cast("array<string>").alias("control_variables"), F.array(F.lit("Quotes of the source"), F.lit("Values of parameters from the source")).alias("missing_information"), F.lit(True).alias("can_generate_ode_template")).alias("model_card"),
    )
    return docs.withColumn("raw", F.to_json(fixed))


def _is_object(c: Column) -> Column:
    return F.coalesce(F.get_json_object(c, "$").isNotNull() & F.try_parse_json(c).isNotNull() & trim_all(c).startswith("{"), F.lit(False))


def repaired(raw: Column | str) -> Column:
    """struct(json, status): the text itself if it is JSON; else what a code fence holds; else from the first { to the last }; else null.

    status is not_needed, repaired or failed.
    """
    c = F.col(raw) if isinstance(raw, str) else raw

    def tried(t: Column) -> Column:
        fenced = F.nullif(trim_all(F.regexp_extract(t, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1)), F.lit(""))
        start, length = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        sliced = F.when((start > 0) & (length >= start), F.substring(t, start, length - start + 1))
        return F.transform(F.array(t, fenced, sliced), lambda x: F.when(F.try_parse_json(x).isNotNull(), x))

    def chosen(ok: Column) -> Column:
        json = F.coalesce(*(ok[k] for k in range(3)))
        return F.struct(json.alias("json"), F.when(ok[0].isNotNull(), "not_needed").when(json.isNotNull(), "repaired").otherwise("failed").alias("status"))

    return bound(bound(c, tried), chosen)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def violations(doc: Column, raw: Column) -> Column:
    """Array of what keeps a parsed document from being valid: absent fields, unknown enum values, blank texts that must not be."""
    fields = "map<string,string>"
    absent = lambda found, path: F.when(found[path.rpartition(".")[2]].isNull(), F.lit(f"{path}: required"))
    blank = lambda c, path: F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"{path}: empty"))

    def each(array: str, texts: tuple[str, ...], needed: tuple[str, ...], enums: dict[str, tuple[str, ...]]) -> Column:
        found = F.transform(doc[array], lambda x, i: F.array_compact(F.array(
            *(F.when(x[f].isNull(), F.concat(F.lit(f"{array}."), i.cast("string"), F.lit(f".{f}: required"))) for f in texts),
            *(F.when(x[f] == "", F.concat(F.lit(f"{array}."), i.cast("string"), F.lit(f".{f}: empty"))) for f in needed),
            *(F.when(~x[f].isin(*values), F.concat(F.lit(f"{array}."), i.cast("string"), F.lit(f".{f}: unknown value"))) for f, values in enums.items()),
        )))
        return F.coalesce(F.flatten(found), F.array().cast("array<string>"))

    level = {"confidence": ("high", "medium", "low")}
    outer = ("paper_title_or_topic", "system_type", "process_description", "state_variables", "parameters", "equations", "assumptions", "limitations", "model_card")
    inner = ("short_summary", "model_type", "inputs", "outputs", "control_variables", "missing_information", "can_generate_ode_template")
    listed = lambda paths: lambda found: F.array(*(absent(found, p) for p in paths))
    card = F.from_json(F.get_json_object(raw, "$.model_card"), fields)
    top = F.array_compact(F.concat(bound(F.from_json(raw, fields), listed(outer)), bound(F.coalesce(card, F.expr("map()").cast(fields)), listed([f"model_card.{p}" for p in inner])), F.array(blank(doc["paper_title_or_topic"], "paper_title_or_topic"))))
    return F.array_distinct(F.concat(
        top,
        each("state_variables", ("symbol", "name", "meaning", "unit", "role", "source_context", "confidence"), ("symbol",), level | {"role": tuple(ROLES)}),
        each("parameters", ("symbol", "name", "value", "unit", "source_context", "confidence"), ("symbol",), level),
        each("equations", ("label", "equation_latex", "equation_plaintext", "meaning", "variables_involved", "source_context", "confidence"), ("equation_latex",), level),
        each("assumptions", ("assumption", "source_context", "confidence"), ("assumption",), level),
        each("limitations", ("limitation", "source_context", "confidence"), ("limitation",), level),
    ))


def validated(answers: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): answers with json, doc and repair_status; those that cannot be repaired or break the schema go to the rejects with 502."""
    # each step goes through explode, so that later filters do not copy its expression into every place that names its result
    once = lambda df, made: df.withColumn("_r", F.explode(F.array(made)))
    out = once(answers, repaired(raw)).withColumns({"json": F.col("_r.json"), "repair_status": F.col("_r.status")}).drop("_r")
    out = once(out, F.from_json("json", EXTRACTION)).withColumnRenamed("_r", "doc")
    broken = F.when(F.col("json").isNull(), F.array(F.lit("no JSON object"))).otherwise(violations(F.col("doc"), F.col("json")))
    out = once(out, broken).withColumnRenamed("_r", "validation_errors")
    bad = out.where(F.size("validation_errors") > 0).withColumn("status_code", F.lit(502))
    return out.where(F.size("validation_errors") == 0), bad.drop("doc")


def rows_of(valid: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """The stored rows of valid documents: extractions and the four child tables; ordinals are places in the document's arrays.

    A value that is no number is stored as 0 with low confidence and the value named in the quote; control is an input.
    Assumptions and limitations share a table, each numbered from 0.
    """
    d = F.col("doc")
    head = valid.select(
        F.col(key).alias("id"), d["paper_title_or_topic"].alias("model_card_title"), d["system_type"].alias("domain"), system_description(d).alias("system_description"),
        problem_statement(d["model_card"]).alias("problem_statement"), ode_stub(d).alias("ode_template"), F.col("json").alias("raw_extraction_json"), "repair_status",
    )
    each = lambda array: valid.select(F.col(key).alias("extraction_id"), F.posexplode(d[array]).alias("ordinal", "x"))
    quote = F.col("x.source_context")
    variables = each("state_variables").select("extraction_id", "ordinal", "x.symbol", "x.name", "x.meaning", "x.unit", F.coalesce(*(F.when(F.col("x.role") == a, F.lit(b)) for a, b in ROLES.items())).alias("role"), quote.alias("source_quote"), "x.confidence")
    p = each("parameters").withColumn("v", parse_number("x.value"))
    parameters = p.select(
        "extraction_id", "ordinal", "x.symbol", "x.name", F.col("v.num").alias("value"), "x.unit",
        F.when(F.col("v.ok"), quote).otherwise(F.concat(F.lit("[value: "), F.col("x.value"), F.lit("] "), quote)).alias("source_quote"), F.when(F.col("v.ok"), F.col("x.confidence")).otherwise("low").alias("confidence"),
    )
    from cardwright.operators.editing import described

    e = each("equations").select("extraction_id", "ordinal", "x.label", F.col("x.equation_latex").alias("latex"), F.col("x.equation_plaintext").alias("plaintext"), "x.meaning", "x.variables_involved", quote.alias("source_quote"), "x.confidence")
    equations = e.withColumn("description", described())
    kind = lambda array, field: each(array).select("extraction_id", "ordinal", F.lit(field).alias("kind"), F.col(f"x.{field}").alias("text"), quote.alias("source_quote"), "x.confidence")
    return {"extractions": head, "equations": equations, "variables": variables, "parameters": parameters, "assumptions": kind("assumptions", "assumption").unionByName(kind("limitations", "limitation"))}


def problem_statement(card: Column) -> Column:
    part = lambda label, c, by=", ": F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, by), F.lit(".")))
    text = F.concat_ws(" ", part("Predict", card["outputs"]), part("Given inputs", card["inputs"]), part("Control variables", card["control_variables"]), part("Missing information", card["missing_information"], "; "))
    return F.when(text == "", "—").otherwise(text)


def ode_stub(doc: Column) -> Column:
    """Code to start from: the parameters with values and units, the states, and a right-hand side to fill in; a note only, where the provider says that there can be none.

    A value that is no number is 0 and named beside it. Scores read this text, so it holds no words of their patterns but the document's own.
    """
    from cardwright.operators.codegen import number_text

    states = F.transform(F.filter(doc["state_variables"], lambda v: v["role"] == "state"), lambda v: v["symbol"])
    names = F.when(F.size(states) > 0, F.array_join(states, ", ")).otherwise("none")

    def entry(p: Column) -> Column:
        unit = F.when(F.coalesce(p["unit"], F.lit("")) == "", "—").otherwise(p["unit"])
        note = F.concat(F.lit('; not a number: "'), F.coalesce(p["value"], F.lit("")), F.lit('"'))
        value = let(parse_number(p["value"]), lambda n: F.when(n["ok"], F.concat(let(n["num"], number_text), F.lit(",  # "), unit)).otherwise(F.concat(F.lit("0.0,  # "), unit, note)))
        return F.concat(F.lit('    "'), p["symbol"], F.lit('": '), value)

    entries = F.transform(doc["parameters"], entry)
    listed = F.when(F.size(entries) > 0, F.array_join(entries, "\n")).otherwise("    # none")
    ones = F.array_join(F.array_repeat(F.lit("1.0"), F.greatest(F.size(states), F.lit(1))), ", ")
    code = F.concat(
        F.lit("# ODE stub: complete the right-hand side below.\n# States: "), names, F.lit("\n\nimport numpy as np\nfrom scipy.integrate import solve_ivp\n\nP = {\n"), listed,
        F.lit("\n}\n\n\ndef rhs(t, y, p):\n    dydt = np.zeros_like(y)\n    # TODO: equations of "), names,
        F.lit("\n    return dydt\n\n\ndef solve(y, span=(0.0, 100.0), points=200):\n    return solve_ivp(rhs, span, y, args=(P,), t_eval=np.linspace(*span, points))\n\n\nif __name__ == \"__main__\":\n    print(solve(["), ones, F.lit("]).y[:, -1])\n"),
    )
    return F.when(doc["model_card"]["can_generate_ode_template"], code).otherwise("# No ODE stub: the provider says that none can be made.\n")


def system_description(doc: Column) -> Column:
    """The process, then the card's summary and model type on lines of their own; absent and empty ones are left out."""
    part = lambda lead, c: F.when(c != "", F.concat(F.lit(lead), c))
    card = doc["model_card"]
    return F.concat_ws("", part("", doc["process_description"]), part("\n\nSummary: ", card["short_summary"]), part("\nModel type: ", card["model_type"]))


def symbol_list(c: Column | str) -> Column:
    """A list of symbols given as a JSON array or separated by commas."""
    t = trim_all(c)
    split = F.filter(F.transform(F.split(t, ","), trim_all), has_text)
    return F.coalesce(F.when(t.startswith("["), F.from_json(t, "array<string>")), split)


def token_cost(prompt: Column, completion: Column) -> Column:
    return prompt * 5e-6 + completion * 15e-6
