"""Rules of scores, units, simulations, requests, exports, scripts and the store on small tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from cardwright.functions.units import label, parse_unit
from cardwright.operators import codegen, evaluate, extract, multisource, projects, simulate
from cardwright.sources import store


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_unit_aliases(spark):
    rows = spark.createDataFrame([("mg/L", "mol/L"), ("mmol/L", "mol/L"), ("h^-1", "d^-1"), ("g/L", "kg/m3"), ("1/h", "h-1"), ("H-1", " 1 / h"), (None, "1/h"), ("m²", "m2")], "a string, b string")
    assert [r[0] for r in rows.select(evaluate.same_unit("a", "b")).collect()] == [False, False, False, False, True, True, False, True]


def test_a_symbol_that_is_not_found_scores_nothing(spark):
    found = spark.createDataFrame([("f", "a", None, 0), ("f", "c", "g/L", 0), ("f", "c", "1/h", 1)], "fixture string, symbol string, unit string, ordinal int")
    expected = spark.createDataFrame([("f", "A", ""), ("f", "b", ""), ("f", "c", "h-1"), ("g", "x", "")], "fixture string, symbol string, unit string")
    assert {r["fixture"]: round(r["units"], 6) for r in evaluate.unit_scores(found, expected).collect()} == {"f": round(2 / 3, 6), "g": 0.0}


def test_equation_symbols(spark):
    rows = spark.createDataFrame([('["X ", "mu"]', "dX/dt = q*X", "(1) growth"), ("a, b", None, None), (None, "y = 2", "")], "v string, p string, l string")
    got = [sorted(r[0]) for r in rows.select(evaluate.equation_symbols("v", "p", "l")).collect()]
    assert got == [["dt", "dx", "growth", "mu", "q", "x"], ["a", "b"], ["y"]]


def test_fixtures_and_scores(spark, tmp_path):
    texts, answers = tmp_path / "texts", tmp_path / "answers"
    texts.mkdir(), answers.mkdir()
    (texts / "decay.txt").write_text("Decay of a tracer\nin a closed vessel, first order.\n")
    (texts / "lost.txt").write_text("A text without an answer of its own here.")
    (answers / "decay.json").write_text(json.dumps({"expected_variable_symbols": ["X"], "expected_parameter_symbols": [], "expected_equation_symbol_sets": [["x", "k"]], "expected_variable_units": {"t": "s"}, "expected_parameter_units": {"k": "s-1"}}))
    docs = evaluate.fixtures(spark, str(texts), str(answers))
    cards = extract.validated(extract.mock(docs, "text"))[0]
    got = {r["fixture"]: r for r in evaluate.golden_scores(cards).collect()}
    r = got["decay"]
    assert (r["variables"], r["parameters"], r["equations"], r["missing_info"]) == (0.5, 1.0, 1.0, 1.0) and r["units"] == 0.5
    assert got["lost"]["golden"] is None
    failed = evaluate.golden_scores(cards.withColumn("doc", F.when(F.lit(False), F.col("doc")))).first()
    assert failed["overall"] == 0.0


def test_missing_info(spark):
    rows = spark.createDataFrame([(["a"], None, None), ([], ["l"], []), (None, [], ["x"]), ([], [], [])], "m array<string>, l array<string>, a array<string>")
    assert [r[0] for r in rows.select(evaluate.missing_info(F.col("m"), F.col("l"), F.col("a"))).collect()] == [1.0, 1.0, 0.5, 0.0]


def test_unit_parser(spark):
    want = {"/h": None, "g/": None, "h^(2)": None, "g^2^-1": "M^-2", "1/h": "T^-1", "g/L/h": "M·V^-1·T^-1", "furlongs": None, "": "-"}
    assert {u: one(spark, u, lambda c: label(parse_unit(c))) for u in want} == want


def test_substrate_is_not_negative_in_the_rates():
    step = simulate.stepper(simulate.DEFAULTS | {"D": 0.0, "Ks": 0.1})
    x, s = step(1.0, -5.0, 0.1)
    assert (x, s) == (1.0, -5.0)
    points = simulate.simulated(simulate.DEFAULTS | {"T": 1.0, "dt": 0.3})
    assert [p[0] for p in points] == [0.0, 0.25, 0.5, 0.75, 1.0] and all(round(p[1], 6) == p[1] for p in points)
    assert simulate.fixed(0.125, 2) == 0.13 and simulate.fixed(1.005, 2) == 1.0


def test_dense_curve():
    curve = simulate.dense_curve(simulate.DEFAULTS | {"D": 0.1, "Sin": 0.0, "S0": 0.0, "X0": 2.0}, 100.0)
    assert len(curve) == 2001 and math.isclose(curve[-1][1], 2 * math.exp(-10), rel_tol=1e-6) and curve[1][0] == 0.05
    assert len(simulate.dense_curve(simulate.DEFAULTS, 1000.0)) == 5001 and len(simulate.dense_curve(simulate.DEFAULTS, 1.0)) == 501


def test_simulation_checks(spark):
    p = spark.createDataFrame([(0.396, 0.4, 0.5, 10.0, 0.0, 5.0, 0.1, 50.0), (0.1, 0.4, 0.5, 10.0, 0.0, 0.0, 5.0, 5.0)], "D double, mumax double, Ks double, Sin double, X0 double, S0 double, dt double, T double")
    got = [(r["errors"], r["warnings"]) for r in simulate.checked(p).collect()]
    assert got == [([], ["washout"]), (["dt must be smaller than T"], ["long steps", "nothing to simulate"])]


def test_one_pass_sets(spark):
    rows = spark.createDataFrame([(" Mu ", "0.4", "1/h", 2, 0), ("mu", "0.4", None, 1, 5), ("MU", "0.5", " ", 3, 0), ("", "9", "x", 1, 1), (None, "9", "x", 1, 1)], "symbol string, value string, unit string, extraction_id int, ordinal int")
    got = multisource.aggregated(rows, values=("value", "unit")).collect()
    assert [(r["key"], r["symbol"], r["values"], r["units"]) for r in got] == [("mu", "mu", ["0.4", "0.5"], ["1/h", " "])]
    texts = spark.createDataFrame([(" A b", 2, 0, "s"), ("a B", 1, 0, "t"), (" ", 0, 0, "s"), (None, 0, 0, "s")], "text string, extraction_id int, ordinal int, source string")
    assert sorted(r["text"] for r in multisource.distinct_texts(texts).collect()) == [" ", " A b", "a B"]
    assert multisource.of_source(texts, "s").count() == 3 and multisource.of_source(texts, "all").count() == multisource.of_source(texts, None).count() == 4


def test_forms_as_written(spark):
    eq = spark.createDataFrame([(" (1)", "X = a", "", 1), ("(1) ", "x = a ", "L", 2), ("(1)", "X = a", "", 3), ("", "", "y", 4), (None, None, "Y ", 5), (" ", "", "", 6)], "label string, plaintext string, latex string, extraction_id int").withColumn("ordinal", F.lit(0))
    got = {r["key"]: (r["display"], r["forms"], r["n_forms"]) for r in multisource.equation_forms(eq).collect()}
    assert got == {"(1)": (" (1)", ["X = a", "x = a "], 2), "y": ("", ["y", "Y "], 2)}


def test_symbol_with_very_many_values(spark):
    hot = spark.range(300_000).select(F.lit(" K ").alias("symbol"), F.concat(F.lit("v"), "id").alias("value"), F.lit("1/h").alias("unit"), F.col("id").alias("extraction_id"), F.lit(0).alias("ordinal"))
    got = multisource.aggregated(hot.unionByName(hot.limit(3).withColumn("symbol", F.lit("other"))), values=("value", "unit"), shown=5).collect()
    assert {r["key"]: (r["n_values"], r["n_units"], len(r["values"])) for r in got} == {"k": (300_000, 1, 5), "other": (3, 1, 3)}
    assert next(r["values"] for r in got if r["key"] == "k") == [f"v{i}" for i in range(5)]
    none = spark.createDataFrame([], "label string, plaintext string, latex string, extraction_id int, ordinal int")
    some = hot.limit(2_500).withColumns({"meaning": F.lit(None).cast("string"), "source": F.lit("s")})
    found = multisource.conflicts(some, some, none, spark.createDataFrame([("s", 1)], "source string, extraction_id long")).where("kind = 'parameter_value'").first()
    assert found["details"].endswith("v999 | and 1500 more")


def test_cards_take_one_exchange(spark):
    cards = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, title string")
    eq = spark.createDataFrame([(1, 1, 10, "y"), (1, 0, 11, "x"), (1, 0, 9, "w"), (9, 0, 12, "orphan")], "extraction_id long, ordinal int, id long, latex string")
    par = spark.createDataFrame([(2, 0, 5, 0.5)], "extraction_id long, ordinal int, id long, value double")
    out = projects.cards(cards, {"equations": eq, "parameters": par})
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {r["id"]: (r["title"], [(x["ordinal"], x["id"], x["latex"]) for x in r["equations"]], [x["value"] for x in r["parameters"]]) for r in out.collect()}
    assert got == {1: ("a", [(0, 9, "w"), (0, 11, "x"), (1, 10, "y")], []), 2: ("b", [], [0.5]), 3: (None, [], [])}


def test_requests(spark):
    rows = spark.createDataFrame([("1", " "), ("0", "x" * 30), (None, "x" * 30), ("7", "x" * 30), ("1.0", None)], "project_id string, content string")
    good, bad = projects.requested(rows, "source")
    assert good.count() == 1 and sorted(map(tuple, (r["fields"] for r in bad.collect()))) == [("content",), ("project_id",), ("project_id",), ("project_id", "content")]
    new = projects.requested(spark.createDataFrame([(3, "private"), (3, None), (-1, "open")], "id long, visibility string"), "visibility")[1]
    assert sorted(map(tuple, (r["fields"] for r in new.collect()))) == [("id", "visibility"), ("visibility",)] and {r["status_code"] for r in new.collect()} == {400}


def test_whole_export_round_trip(spark):
    p = spark.createDataFrame([(1, 'a "quoted" name', "d\n2"), (2, "b", None)], "id long, name string, description string").withColumn("created_at", F.lit("2024-01-02T00:00:00Z"))
    e = store.conform(spark.createDataFrame([(10, 1, "openai", "t2"), (11, 1, "other", "t1")], "id long, project_id long, provider_used string, model_card_title string"), "extractions").withColumn("created_at", F.lit("2024-01-03T00:00:00Z"))
    s = store.conform(spark.createDataFrame([(5, 1, "text", "some \\ text")], "id long, project_id long, kind string, content string"), "source_documents").withColumn("created_at", F.lit("2024-01-03T00:00:00Z"))
    children = {t: store.conform(spark.createDataFrame([], "id long"), t) for t in ("equations", "variables", "assumptions")}
    children["parameters"] = store.conform(spark.createDataFrame([(1, 10, 1, "k2", 2.5), (2, 10, 0, "k1", None)], "id long, extraction_id long, ordinal int, symbol string, value double"), "parameters")
    docs = projects.export_all(p, s, e, children, "2026-01-01T00:00:00Z")
    assert all(json.loads(r["json"])["version"] == "1" and len(json.loads(r["json"])["data"]) == 1 for r in docs.collect())
    got = store.import_rows(docs.select("json"), p.limit(0))
    assert {(r["name"], r["description"]) for r in got["projects"].collect()} == {('a "quoted" name', "d\n2"), ("b", "")}
    assert sorted((r["provider_used"], r["model_card_title"]) for r in got["extractions"].collect()) == [("mock", "t1"), ("openai", "t2")]
    assert sorted((r["ordinal"], r["symbol"], r["value"]) for r in got["parameters"].collect()) == [(0, "k1", 0.0), (1, "k2", 2.5)] and got["source_documents"].first()["content"] == "some \\ text"


def test_store_keeps_every_manifest(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert s.manifest() == {} and s.read("projects").count() == 0
    s.write({"projects": spark.createDataFrame([(1, "p")], "id long, name string")})
    old = store.Store(spark, s.path).manifest()
    s.write({"projects": spark.createDataFrame([(2, "q")], "id long, name string")}, append=True)
    assert s.read("projects").count() == 2 and len(old["projects"]) == 1
    assert sorted(x.name for x in (tmp_path / "s").glob("manifest-*.json")) == ["manifest-000000001.json", "manifest-000000002.json"]


def test_sections_and_initial_states(spark):
    d = codegen.DIVIDER
    code = f"before\n{d}\n# ONE\n{d}\na = 1\n\n{d}\n# TWO WORDS\n{d}\nb\n{d}\n# ONE\n{d}\nlast\n"
    assert one(spark, code, codegen.sections) == {"TWO WORDS": "b", "ONE": "last"} and one(spark, "none", codegen.sections) == {}
    cards = spark.createDataFrame([(1, "T")], "extraction_id long, title string")
    eq = spark.createDataFrame([(1, 0, "dX/dt = -k * X", "", "q"), (1, 1, "z = strange(X)", "", "q")], "extraction_id long, ordinal int, latex string, description string, source_quote string")
    var = spark.createDataFrame([(1, 0, "X", "X", "g/L", "state", "q"), (1, 1, "S", "S", None, "state", "q")], "extraction_id long, ordinal int, symbol string, name string, unit string, role string, source_quote string")
    par = spark.createDataFrame([(1, 0, "k", "k", 0.5, "1/d", "high", "q")], "extraction_id long, ordinal int, symbol string, name string, value double, unit string, confidence string, source_quote string")
    raw = spark.createDataFrame([(1, '{"state_variables": [{"symbol": "x", "initial_condition": 0.25}, {"symbol": "S", "initial_condition": "unknown"}]}')], "extraction_id long, raw string")
    code = codegen.scripts(cards, eq, var, par, raw).first()["code"]
    compile(code, "script", "exec")
    assert "    0.25,  # X, g/L" in code and "0.0,  # TODO: set; " in code and "# in d" in code and "dSdt = 0.0  # TODO: no equation matched" in code and "z = 0.0" in code and "    k = p[\"k\"]" in code
    files = {r["filename"]: r["content"] for r in codegen.package(cards, eq, var, par, reports=raw).collect()}
    assert json.loads(files["model_notebook.ipynb"])["cells"][8]["source"].startswith("params = {") and json.loads(files["raw_extraction.json"])["state_variables"]


@pytest.mark.parametrize("text,want", [("a text without any JSON", "failed"), ('{"a": 1}', "not_needed"), ('```json\n{"a": 1}\n```', "repaired"), ('so: {"a": 1} there', "repaired"), (None, "failed")])
def test_repair(spark, text, want):
    r = one(spark, text, extract.repaired)
    assert r["status"] == want and (r["json"] is None) == (want == "failed")


def test_update_can_clear(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "id long, x string, y string")
    patch = spark.createDataFrame([(1, None, None)], "id long, x string, y string")
    assert sorted(map(tuple, store.update(rows, patch, "id", clear=("x",)).collect())) == [(1, None, "b"), (2, "a", "b")]
