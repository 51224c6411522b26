"""Operators on rows of a model card's own shape."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cardwright.functions import text as X
from cardwright.functions.units import label, normal_equation, parse_unit
from cardwright.operators import classify as C
from cardwright.operators import codegen, editing, evaluate, extract, multisource, projects, reproducibility, simulate, templates, units
from cardwright.sources import ingest, series_csv, store


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value,num,ok", [("0.5", 0.5, True), ("", 0.0, True), ("~0.1", 0.1, True), ("0.35–0.50", 0.35, True), ("1,000", 1.0, True), ("~.5", 5.0, True), ("0x10", 16.0, True), ("none", 0.0, False), (" 2e3 ", 2000.0, True), ("1d", 1.0, True)])
def test_numbers(spark, value, num, ok):
    assert one(spark, value, X.parse_number) == Row(num=num, ok=ok)


def test_texts(spark):
    assert one(spark, " \t x \n", X.trim_all) == "x"
    assert one(spark, "1.5abc", X.leading_number) == 1.5
    assert one(spark, 'a,"b', X.csv_cell) == '"a,""b"'
    assert one(spark, "My Model — v2!", X.slug) == "my_model_v2"
    assert [one(spark, v, X.has_value) for v in (None, " N/A ", "—", "x")] == [False, False, False, True]
    assert [one(spark, v, X.has_text) for v in (None, " ", "—")] == [False, False, True]
    assert one(spark, "hour and our", lambda c: X.hits(c, "our")) == 2
    assert one(spark, "μmax is not mumax", lambda c: X.has_word(c, F.lit("max"))) is True
    assert one(spark, "mumax", lambda c: X.has_word(c, F.lit("max"))) is False
    assert one(spark, "X" * 200, lambda c: F.length(X.capped(c))) == 90
    assert spark.range(1).select(X.round_half_up(F.lit(1.005), 2)).first()[0] == 1.0


@pytest.mark.parametrize("unit,dims", [("", "-"), ("g-X/g-S", "-"), ("G/L", "M·V^-1"), ("h^-1", "T^-1"), ("h⁻¹", "T^-1"), ("h-1", "T^-1"), ("g/L/h", "M·V^-1·T^-1"), ("mol/L", "V^-1·N"), ("furlongs/fortnight", None), ("hours", None), ("dm3", "V")])
def test_unit_parser(spark, unit, dims):
    assert one(spark, unit, lambda c: label(parse_unit(c))) == dims


def test_fractions_stay_unreadable(spark):
    assert one(spark, r"\frac{dX}{dt} = \mu X", normal_equation) == "((dx)/(dt)) = mu x"


@pytest.fixture(scope="module")
def chemostat(spark):
    eq = spark.createDataFrame([(1, 0, "mu = mumax * S / (Ks + S)"), (1, 1, "dX/dt = (mu - D) * X"), (1, 2, "dS/dt = D * (Sin - S) - (1/Yxs) * mu * X"), (2, 0, "dC/dt = -k * C"), (3, 0, "dC/dt = k * C"), (3, 1, "kLa * (Cs - C)")], "extraction_id long, ordinal int, latex string")
    eq = eq.withColumns({"description": F.lit(""), "source_quote": F.lit("q"), "variables_involved": F.lit(None).cast("array<string>")})
    var = spark.createDataFrame([(1, 0, "X", "g/L", "state"), (1, 1, "S", "g/L", "state"), (1, 2, "t", "h", "input"), (2, 0, "C", "mol/L", "state"), (3, 0, "C", "mol/L", "state")], "extraction_id long, ordinal int, symbol string, unit string, role string").withColumns({"name": F.col("symbol"), "source_quote": F.lit("q")})
    par = spark.createDataFrame([(1, 0, "mumax", 0.5, "1/h"), (1, 1, "Ks", 0.2, "g/L"), (1, 2, "D", 0.3, "1/h"), (1, 3, "Sin", 10.0, "g/L"), (1, 4, "Yxs", 0.5, "g/g"), (1, 5, "mu", 0.4, "1/h"), (2, 0, "k", 0.1, "1/s"), (3, 0, "k", 0.1, None)], "extraction_id long, ordinal int, symbol string, value double, unit string").withColumns({"name": F.col("symbol"), "source_quote": F.lit("q"), "confidence": F.lit("high")})
    return eq, var, par


def test_templates(spark, chemostat):
    got = {(r["extraction_id"], r["ordinal"]): (r["kind"], r["code"]) for r in templates.match(*chemostat).collect()}
    assert got[1, 0] == ("matched", "mu = mumax * S / (Ks + S)")
    assert got[1, 1] == ("derivative", "dXdt = (mu - D) * X")
    assert got[1, 2] == ("derivative", "dSdt = D * (Sin - S) - (1.0 / Yxs) * mu * X")
    assert got[2, 0] == ("derivative", "dCdt = -k * C")
    assert got[3, 0] == ("unmatched", None)
    cards = spark.createDataFrame([(1,), (2,), (3,)], "extraction_id long")
    assert {r["extraction_id"]: r["status"] for r in templates.status(cards, templates.match(*chemostat)).collect()} == {1: "full", 2: "full", 3: "scaffold_only"}


def test_formal_dimensions(spark, chemostat):
    eq, var, par = chemostat
    got = {(r["extraction_id"], r["ordinal"]): (r["pattern"], r["matches"]) for r in units.formal(eq, units.dimension_map(var, par)).collect()}
    assert got[1, 0] == ("monod", True) and got[1, 1] == ("biomass", True) and got[1, 2] == ("substrate", True)
    assert got[2, 0][0] == "ode" and got[3, 1] == ("gas_liquid", None)
    cards = spark.createDataFrame([(1,), (4,)], "extraction_id long")
    assert {r["extraction_id"]: r["status"] for r in units.formal_status(cards, units.formal(eq, units.dimension_map(var, par))).collect()} == {1: "pass", 4: "unavailable"}


def test_heuristic_rules(spark, chemostat):
    eq, var, par = chemostat
    cards = spark.createDataFrame([(1, ""), (3, "oxygen transfer")], "extraction_id long, corpus string")
    found = {(r["extraction_id"], r["rule"], r["subject"]) for r in units.heuristic(cards, eq, var, par).collect()}
    assert (1, "rate_unit", "Ks") in found  # listed among rates, so a right unit is doubted
    assert (3, "parameter_without_unit", "k") in found and (3, "gas_without_kla", None) in found


def test_classifier(spark):
    cards = spark.createDataFrame([(1, None, "Chemostat model for E. coli growth", None), (2, "", "", ""), (3, "Rate constant", "", "")], "id long, source_text string, title string, domain string").withColumns({c: F.lit(None).cast("array<string>") for c in ("variable_names", "variable_symbols", "parameter_names", "parameter_symbols")})
    got = {r["id"]: r for r in C.classify_cards(cards).collect()}
    assert got[1]["model_type"] == "chemostat" and got[1]["confidence"] == 0.64
    assert (got[2]["model_type"], got[2]["confidence"], got[2]["matched_keywords"]) == ("generic_ode", 0.0, [])
    assert got[3]["model_type"] == "cstr"
    assert {k: len(v) for k, v in C.rules().items()} == {"chemostat": 18, "batch_reactor": 13, "fed_batch": 14, "cstr": 18, "gas_liquid_transfer": 18, "microalgae_pbr": 18}
    items = spark.createDataFrame([(1, "variables", "x", "Biomass"), (1, "parameters", "mu_max", "")], "extraction_id long, part string, symbol string, name string")
    covered = C.coverage(spark.createDataFrame([(1, "chemostat")], "extraction_id long, model_type string"), items)
    assert C.missing_required(covered).first()[1:] == (1, 4)


def test_extraction_pipeline(spark):
    docs = spark.createDataFrame([(1, "\n  A chemostat with Monod kinetics, described at length.\nmore"), (2, "short"), (3, "  ")], "id long, content string")
    usable, rejected = extract.guarded(docs)
    assert [r["id"] for r in usable.collect()] == [1] and {r["status_code"] for r in rejected.collect()} == {400}
    valid, bad = extract.validated(extract.mock(usable))
    assert bad.count() == 0 and valid.first()["doc"]["paper_title_or_topic"] == "A chemostat with Monod kinetics, described at length."
    rows = extract.rows_of(valid)
    assert rows["parameters"].first()["value"] == 0.1 and rows["assumptions"].count() == 3  # two assumptions and a limitation
    assert extract.choose_provider(None, {}) == "mock" and extract.choose_provider("ollama", {}) == "mock"
    with pytest.raises(ValueError):
        extract.choose_provider("openai", {})
    raw = valid.first()["raw"]
    odd = json.loads(raw)
    odd["parameters"][0]["value"] = "not-a-number"
    odd["state_variables"][0]["role"] = "control"
    answers = spark.createDataFrame([(1, f"```json\n{raw}\n```"), (2, f"Here: {raw} ok"), (3, "{}"), (4, "nothing"), (5, json.dumps(odd))], "id long, raw string")
    valid, bad = extract.validated(answers)
    assert {r["id"]: r["repair_status"] for r in valid.collect()} == {1: "repaired", 2: "repaired", 5: "not_needed"} and {r["id"] for r in bad.collect()} == {3, 4}
    p = extract.rows_of(valid.where("id = 5"))["parameters"].first()
    assert (p["value"], p["confidence"]) == (0.0, "low") and "not-a-number" in p["source_quote"]
    assert extract.rows_of(valid.where("id = 5"))["variables"].first()["role"] == "input"
    assert extract.ask(usable, lambda t: 1 / 0).first()["status_code"] == 502


def test_conflicts(spark):
    p = spark.createDataFrame([("mu_max", "0.4", "1/h", "A", 1), ("mu_max ", "0.6", "1/day", "B", 2)], "symbol string, value string, unit string, source string, extraction_id int").withColumns({"ordinal": F.lit(0), "meaning": F.lit(None).cast("string")})
    v = spark.createDataFrame([("X", "g/L", "Biomass", "A", 1), ("X", "mg/L", "Biomass concentration", "B", 2)], "symbol string, unit string, meaning string, source string, extraction_id int").withColumn("ordinal", F.lit(0))
    e = spark.createDataFrame([("(1)", "dX/dt=(mu-D)*X", "A", 1), ("(1)", "dX/dt=(mu-D)*X + k", "B", 2)], "label string, plaintext string, source string, extraction_id int").withColumns({"latex": F.lit(""), "ordinal": F.lit(0)})
    two = spark.createDataFrame([("A", 1), ("B", 2)], "source string, extraction_id int")
    assert sorted(r["kind"] for r in multisource.conflicts(p, v, e, two).collect()) == ["equation", "parameter_unit", "parameter_value", "variable_definition"]
    three = two.union(spark.createDataFrame([("C", 3)], two.schema))
    lost = multisource.conflicts(p, v, e, three).where("kind = 'missing_across_sources'").collect()
    assert [(r["subject"], r["details"]) for r in lost] == [("mu_max", "C")]


def test_edits(spark):
    rows = spark.createDataFrame([(1, "a", "m", "p", "d", False, None), (2, "b", "m", "m", "d", False, None)], "id long, label string, meaning string, plaintext string, description string, edited_by_user boolean, original_value string")
    edited = editing.patch(rows, spark.createDataFrame([(1, "new")], "id long, label string"), editing.FIELDS["equations"])
    again = editing.patch(edited, spark.createDataFrame([(1, "newer")], "id long, label string"), editing.FIELDS["equations"])
    r = again.where("id = 1").first()
    assert (r["label"], r["description"], r["edited_by_user"], json.loads(r["original_value"])["label"]) == ("newer", "[newer] m (p)", True, "a")
    assert sorted(map(tuple, editing.reset(again, rows.select("id"), editing.FIELDS["equations"]).collect())) == sorted(map(tuple, rows.collect()))
    reviews = spark.createDataFrame([(1, {"units_ok": True})], "extraction_id long, checks map<string,boolean>")
    defaults = spark.createDataFrame([({"units_ok": False, "values_ok": False},)], "default_checks map<string,boolean>")
    assert editing.open_issues(reviews, defaults).first()["issues"] == ["values ok"]
    e = spark.createDataFrame([(1, None)], "id long, model_type_override string")
    out, bad = editing.override_type(e, spark.createDataFrame([(1, "cstr"), (9, None), (1, "nonsense")], e.schema), ("cstr",))
    assert out.first()[1] == "cstr" and sorted(r["status_code"] for r in bad.collect()) == [400, 404]


CSV = "# note\r\nTime, X ,S,DO\n0,0.1,10,8\n2,0.2,9\n\n4,-1,8,x\n3,1,1,1\n5,bad,1,1\n6,0.5,7,1\n8,1.5abc,6,1\n"


def test_series_files(spark):
    files = spark.createDataFrame([("a", CSV), ("b", "t,X,S\n0,1,1\n"), ("c", "a,b\n1,2\n"), ("d", "")], "file_id string, content string")
    rows, messages, status = series_csv.parse(files)
    assert [tuple(r)[1:] for r in rows.where("file_id = 'a'").orderBy("row").collect()] == [(2, 0.0, 0.1, 10.0, 8.0, None), (3, 2.0, 0.2, 9.0, None, None), (4, 4.0, 0.0, 8.0, None, None), (7, 6.0, 0.5, 7.0, 1.0, None), (8, 8.0, 1.5, 6.0, 1.0, None)]
    said = {(r["file_id"], r["row"], r["severity"]) for r in messages.collect()}
    assert {("a", 5, "error"), ("a", 6, "error"), ("a", 4, "warning"), ("b", None, "error"), ("c", None, "error"), ("d", None, "error")} == said
    assert {r["file_id"]: (r["ok"], r["n_rows"]) for r in status.collect()} == {"a": (False, 5), "b": (False, 1), "c": (False, 0), "d": (False, 0)}
    many = spark.createDataFrame([("m", "t,X,S\n" + "".join(f"{i},1,1\n" for i in range(10_001)))], files.schema)
    rows, messages, status = series_csv.parse(many)
    assert rows.count() == 10_000 and status.first()["ok"] and messages.first()["severity"] == "warning"


def test_simulation_and_fit(spark):
    points = simulate.simulate(spark.createDataFrame([(1, 0.2)], "id long, D double")).orderBy("t").collect()
    assert len(points) == 501 and abs(points[-1]["X"] - 4.95) < 0.05
    at = spark.range(1).select(simulate.steady_state(F.lit(0.5), F.lit(0.2), F.lit(0.5), F.lit(0.25), F.lit(10.0)).alias("s")).first()["s"]
    assert (round(at["S"], 6), round(at["X"], 6), at["washout"]) == (0.2, 4.9, False)
    run = simulate.simulate(spark.createDataFrame([(1, 12.0, 0.05)], "series_id long, T double, dt double"), "series_id").where("cast(t * 20 + 0.5 as int) % 20 = 0")
    got = simulate.fit(run, free=("mumax",), guess={"mumax": 0.3, "Ks": 0.1, "D": 0.2}).first()
    assert abs(got["mumax"] - 0.4) < 1e-3 and got["r2_X"] > 0.999
    checked = simulate.checked(spark.createDataFrame([(-1.0, 0.6)], "Ks double, D double")).first()
    assert checked["errors"] == ["Ks must be positive"] and checked["warnings"] == ["washout"]


def test_reproducibility(spark, chemostat):
    eq, var, par = chemostat
    e = spark.createDataFrame([(1, "Chemostat", "initial concentration; feed", "", "{}"), (9, "", "", "", None)], "id long, system_description string, problem_statement string, ode_template string, raw_extraction_json string")
    known = reproducibility.facts(e, eq.withColumn("description", F.lit("d")), var, par)
    found = reproducibility.findings(known, e, eq.withColumn("description", F.lit("d")), var, par)
    got = {r["extraction_id"]: r for r in reproducibility.scores(known, found).collect()}
    assert (got[1]["overall"], got[1]["readiness"]) == (100.0, "ready")
    assert (got[9]["overall"], got[9]["readiness"]) == (0.0, "not_ready") and got[9]["criticals"] > 0
    assert reproducibility.next_steps(reproducibility.scores(known, found), known).count() == 2


def test_evaluation(spark):
    row = spark.createDataFrame([(["X", "S "], ["x", "S", "V"], [["X", "mu"]], [["X", "mu", "D"], ["S"]])], "a array<string>, b array<string>, c array<array<string>>, d array<array<string>>")
    r = row.select(evaluate.jaccard(F.col("a"), F.col("b")).alias("j"), evaluate.recall(F.col("c"), F.col("d")).alias("r"), evaluate.jaccard(F.col("a"), F.array().cast("array<string>")).alias("e")).first()
    assert (round(r["j"], 4), r["r"], r["e"]) == (0.6667, 0.5, 1.0)
    assert [one(spark, v, lambda c: evaluate.same_unit(c, F.lit("1/h"))) for v in ("h-1", "h⁻¹", "g/L", None)] == [True, True, False, False]


def test_store_and_cards(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.write({"projects": spark.createDataFrame([(1, "p", None, "public"), (2, "q", "u", "private")], "id long, name string, owner_id string, visibility string"), "extractions": spark.createDataFrame([(5, 1, "T")], "id long, project_id long, model_card_title string")})
    with pytest.raises(ValueError):
        s.write({"variables": spark.createDataFrame([(1,)], "nonsense long")})
    s.write({"variables": spark.createDataFrame([(1, 5, 1, "S"), (2, 5, 0, "X")], "id long, extraction_id long, ordinal int, symbol string")}, append=True)
    children = {t: s.read(t) for t in ("equations", "variables", "parameters", "assumptions")}
    card = projects.cards(s.read("extractions"), children).first()
    assert [v["symbol"] for v in card["variables"]] == ["X", "S"] and card["equations"] == []
    assert [r["name"] for r in projects.visible(s.read("projects"), None).collect()] == ["p"]
    doc = projects.export_project(s.read("projects"), s.read("source_documents"), s.read("extractions"), children, "2024-01-01").where("project_id = 1").first()["json"]
    assert json.loads(doc)["modelCards"][0]["variables"][0]["symbol"] == "X"
    left = store.delete_cascade({"projects": s.read("projects"), "extractions": s.read("extractions"), "variables": s.read("variables")}, "projects", spark.createDataFrame([(1,)], "id long"))
    assert [left[t].count() for t in ("projects", "extractions", "variables")] == [1, 0, 0]
    assert s.lookup("projects", 2).first()["name"] == "q" and projects.shared(s.read("extractions"), s.read("projects"), children, 5).count() == 1


def test_package_and_sources(spark, chemostat):
    cards = spark.createDataFrame([(1, "Chemostat"), (3, "Gas")], "extraction_id long, title string")
    files = codegen.package(cards, *chemostat)
    got = {r["filename"]: r["content"] for r in files.where("extraction_id = 1").collect()}
    assert set(got) == set(codegen.FILES) and len(codegen.FILES) == 15
    compile(got["simulate.py"], "simulate.py", "exec")
    book = json.loads(got["model_notebook.ipynb"])
    assert [c["cell_type"] for c in book["cells"]] == ["markdown"] * 7 + ["code"] * 6 + ["markdown"]
    report = json.loads(got["reproducibility_report.json"])
    assert set(report) >= {"overall", "readiness", "scores", "findings", "next_steps"} and set(report["scores"]) == set(reproducibility.WEIGHTS) and all(f["severity"] in reproducibility.SEVERITIES for f in report["findings"])
    assert got["parameters.csv"].split("\n")[0] == "symbol,name,value,unit,confidence" and codegen.archive(files, 1)[:2] == b"PK"
    pdfs = spark.createDataFrame([(1, "data:application/pdf;base64,aGVsbG8="), (2, "!!"), (3, "aGVsbG8=")], "id long, data string")
    good, bad = ingest.pdf_texts(pdfs, lambda raw: (raw.decode() * 20, 2))
    assert {r["id"]: (r["chars"], r["page_chars"]) for r in good.collect()} == {1: (100, [50, 50]), 3: (100, [50, 50])} and [r["id"] for r in bad.collect()] == [2]
    assert one(spark, "ab\fcd", lambda c: ingest.page_chars(c, 2)) == [2, 2] and one(spark, " a  b ", ingest.word_count) == 2


def test_stream_of_documents(spark, tmp_path):
    from cardwright.streaming.classify import classify_stream, write_stream

    spark.createDataFrame([(1, "a chemostat at steady state")], "id long, text string").write.parquet(f"{tmp_path}/in")
    docs = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
    write_stream(classify_stream(docs).select("id", "model_type"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").first()["model_type"] == "chemostat"
