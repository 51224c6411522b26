"""Plans and tasks that have to stay small as tables grow."""

import pytest
from pyspark.sql import functions as F

from cardwright.functions.text import let
from cardwright.functions.units import label, parse_unit
from cardwright.operators import multisource, units


def _size(df) -> int:
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_a_value_named_often_is_worked_out_once(spark):
    df = spark.range(3).select(let(F.uuid(), lambda u: F.concat(u, F.lit("="), u)).alias("x"))
    assert all(a == b for a, b in (r.x.split("=") for r in df.collect()))


def test_unit_labels_read_their_unit_once(spark):
    df = spark.createDataFrame([("g/L",), ("furlong",), (None,), ("1/h^2",)], "u string").select(label(parse_unit("u")).alias("d"))
    assert [r.d for r in df.collect()] == ["M·V^-1", None, "-", "T^-2"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") < 40  # some thousand when each place had a copy


def test_formal_checks_have_small_plans(spark):
    eq = spark.createDataFrame([(1, 0, "dX/dt = (mu - D) * X", "")], "extraction_id int, ordinal int, latex string, description string")
    var = spark.createDataFrame([(1, 0, "X", "g/L")], "extraction_id int, ordinal int, symbol string, unit string")
    par = spark.createDataFrame([(1, 0, "mu", "1/h"), (1, 1, "D", None)], "extraction_id int, ordinal int, symbol string, unit string")
    out = units.formal(eq, units.dimension_map(var, par))
    r = out.first()
    assert (r.pattern, r.matches, r.lhs) == ("biomass", False, "M·V^-1·T^-1") and r.issues == ["d is no rate"]
    assert _size(out) < 200_000


def test_series_are_fitted_together_and_as_alone():
    """One call fits many series; each goes its own way through the search."""
    import numpy as np

    from cardwright.operators import simulate

    made = [np.array(simulate.simulated(simulate.DEFAULTS | {"mumax": m, "T": 8.0, "dt": 0.5})) for m in (0.4, 0.55)]
    t, x, s = (np.stack([p[:, k] for p in made]) for k in range(3))
    both = simulate.fitted(t, x, s, ("mumax",), simulate.DEFAULTS)
    alone = [simulate.fitted(t[i : i + 1], x[i : i + 1], s[i : i + 1], ("mumax",), simulate.DEFAULTS) for i in range(2)]
    assert all(both[k][i] == alone[i][k][0] for k in both for i in range(2)) and both["mumax"].round(2).tolist() == [0.4, 0.55]


def test_simulations_are_dealt_over_tasks(spark):
    from cardwright.operators import simulate

    p = spark.range(40).coalesce(1).withColumn("T", F.lit(1.0))
    assert simulate.simulate(p).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_numbers_and_wrapped_texts_are_read_once(spark):
    import __spark_entry__
    from cardwright.functions.text import parse_number

    df = spark.createDataFrame([("12 g",), ("0x10",), ("1e999",), ("",), (None,)], "t string").select(parse_number("t").alias("n"))
    assert [(r.n.num, r.n.ok) for r in df.collect()] == [(12.0, True), (16.0, True), (0.0, False), (0.0, True), (0.0, True)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(df).count("regexp_replace(") == 1
    wrapped = __spark_entry__.queries()["wrapped_comments"](spark, "/root/testdata/sf0.001")
    assert plan(wrapped).count("aggregate(") == 1


def test_headers_are_read_once_a_file(spark):
    from cardwright.sources import series_csv

    files = spark.createDataFrame([("a", "Time,X,S\n1,2,-3\n2,x,1\n"), ("b", "Time\n1\n"), ("c", "")], "file_id string, content string")
    rows, messages, status = series_csv.parse(files)
    got = sorted((m.file_id, m.row or 0, m.severity, m.message) for m in messages.collect())
    assert [g[:3] for g in got] == [("a", 0, "error"), ("a", 2, "warning"), ("a", 3, "error"), ("b", 0, "error"), ("b", 0, "error"), ("c", 0, "error")]
    # one pass counts the accepted rows, one tells of all rows; there were more, one for each kind of message
    assert messages._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2


def test_conflicts_make_a_symbols_sets_once(spark):
    rows = spark.range(10).selectExpr("cast(id % 3 as string) symbol", "cast(id as string) value", "'g' unit", "'m' meaning", "cast(id % 2 as string) source", "id % 2 AS extraction_id", "id AS ordinal", "'' label", "'' plaintext", "'' latex")
    found = multisource.conflicts(rows, rows, rows, rows.select("source", "extraction_id").distinct())
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 24  # 32 where each kind made them anew
    assert sorted((r["kind"], r["subject"]) for r in found.collect()) == [("parameter_value", k) for k in "012"]


SMALL = "/root/testdata/sf0.001"


def test_answers_are_checked_once_for_all_tables(spark):
    from cardwright.plans.records import extraction_chain

    assert "from_json" not in extraction_chain(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()  # once for each of five tables before


def test_guards_and_first_lines_of_odd_texts(spark):
    from cardwright.functions.text import first_line, trim_all
    from cardwright.operators.extract import guarded

    texts = [None, "", " \n\t", "a", "a" * 29, "a" * 30, f"\n{'a' * 29}  ", f"a{' ' * 28}b", f"a{' ' * 27}b", f"a{' ' * 100_000}", f"{' ' * 100_000}b", "  x \r\ny", "\r\r z　\rmore", "\U0001f600" * 30, "\U0001f600" * 29, "a\n" * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    good, bad = guarded(rows)
    trimmed = {r.id: r.t for r in rows.select("id", trim_all(F.coalesce("content", F.lit(""))).alias("t")).collect()}
    assert {r.id for r in good.collect()} == {k for k, t in trimmed.items() if len(t) >= 30}
    assert {r.id: (r.reason, r.status_code) for r in bad.collect()} == {k: ("the source is too short" if t else "the source is empty", 400) for k, t in trimmed.items() if len(t) < 30}
    lines = F.filter(F.transform(F.split("content", "\r\n|\r|\n"), trim_all), lambda x: x != "")
    assert all(r.a == r.b for r in rows.select(first_line("content").alias("a"), F.try_element_at(lines, F.lit(1)).alias("b")).collect())
    assert "split(" not in rows.select(first_line("content"))._jdf.queryExecution().optimizedPlan().toString()


def test_series_files_are_read_once(spark):
    from cardwright.plans.files import series_source_rows

    assert "RelationV2" not in series_source_rows(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()  # the data source was scanned for each table made of lines


def test_exported_documents_are_made_once(spark):
    from cardwright.plans.records import export_import

    assert "to_json" not in export_import(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()  # the export was made anew for each table read from it


def test_lines_of_cards_are_grouped_once_and_buckets_grow_with_the_table(spark):
    """No rule reads or groups the orders' lines anew, and a task's share of them stays as it is when there are more."""
    from cardwright.plans.checks import first_derivatives
    from cardwright.plans.records import card_findings, card_unit_findings
    from cardwright.sources.work import BUCKET_ROWS, buckets

    assert buckets(spark, 0) == 4 and buckets(spark, 40 * BUCKET_ROWS + 1) == 41
    for query in (card_findings, card_unit_findings, first_derivatives):
        assert not [f for f in query(spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


def test_symbols_are_looked_up_without_joins_by_symbol(spark):
    eq = spark.createDataFrame([(1, 0, "dX/dt = q * X", "", ["X", "q", "Q"]), (2, 0, "a", "", None)], "extraction_id int, ordinal int, latex string, description string, variables_involved array<string>")
    var = spark.createDataFrame([(1, 0, "X", None, "state"), (2, 0, None, None, "input")], "extraction_id int, ordinal int, symbol string, unit string, role string")
    par = spark.createDataFrame([(1, 0, "q", "1/h"), (2, 0, "Q", "1/h")], "extraction_id int, ordinal int, symbol string, unit string")
    found = units.heuristic(spark.createDataFrame([(1, ""), (2, "")], "extraction_id int, corpus string"), eq, var, par)
    got = {(r.extraction_id, r.rule, r.subject) for r in found.collect()}
    assert got == {(1, "state_without_unit", "X"), (1, "listed_symbol_undefined", "Q"), (1, "derivative_without_unit", "X"), (1, "symbol_undefined", "dX"), (2, "parameter_unused", "Q")}
    plan = found.where("rule IN ('listed_symbol_undefined', 'symbol_undefined', 'derivative_without_unit')")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_symbol_maps_are_joined_by_card(spark):
    """Variables come before parameters, the last of equal variables and the first of equal parameters count; the two are not grouped as one table."""
    var = spark.createDataFrame([(1, 0, "X", "a"), (1, 1, "x", "b"), (2, 0, None, "c")], "extraction_id int, ordinal int, symbol string, unit string")
    par = spark.createDataFrame([(1, 0, "X", "d"), (1, 1, "q", "e"), (1, 2, "Q", "f"), (3, 0, "k", "g")], "extraction_id int, ordinal int, symbol string, unit string")
    out = units.symbol_map(var, par, lower=True)
    got = {r.extraction_id: {k: (v.symbol, v.unit, v.source) for k, v in r.symbols.items()} for r in out.collect()}
    assert got == {1: {"x": ("x", "b", "variable"), "q": ("q", "e", "parameter")}, 3: {"k": ("k", "g", "parameter")}}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["equation_dimensions", "equation_status", "card_next_steps", "package_files"])
def test_rows_of_cards_are_not_broadcast(spark, name):
    """Sizes are told from those of the files, which maps of all cards' rows outgrow many times: at 6 x sf0.1 the driver had no room for them."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [extraction_id" in plan and "BroadcastHashJoin [extraction_id" not in plan


def test_rows_of_symbols_are_dealt_once_unless_there_are_many(spark, monkeypatch):
    """Sets, their order and their sizes are the same whether a symbol's rows are dealt by symbol or by value."""
    rows = spark.range(90).selectExpr("CASE WHEN id % 3 = 0 THEN ' A ' WHEN id % 30 = 1 THEN 'b' ELSE 'a' END symbol", "cast(id * 7 % 11 as string) value", "CASE WHEN id % 2 = 0 THEN 'g' WHEN id % 5 = 0 THEN '' END unit", "id % 4 AS extraction_id", "id AS ordinal")
    results = []
    for often in (10_000, 10, 0):
        monkeypatch.setattr(multisource, "OFTEN", often)
        out = multisource.aggregated(rows, values=("value", "unit"), shown=6)
        if often == 10_000:
            assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # six before
        results.append(sorted(map(tuple, out.collect())))
    assert results[0] == results[1] == results[2]
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in results[0]] == [("a", " A ", ["g"], 11, 1), ("b", "b", [], 3, 0)] and len(results[0][0][2]) == 6


def test_tasks_of_symbols_grow_with_their_rows(spark, monkeypatch):
    from cardwright.sources import work

    monkeypatch.setattr(work, "BUCKET_ROWS", 30)
    rows = spark.range(90).selectExpr("cast(id % 9 as string) symbol", "cast(id as string) value", "0 AS extraction_id", "id AS ordinal")
    out = multisource.aggregated(rows, values=("value",))
    assert "hashpartitioning(key" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 6), REPARTITION_BY_NUM" in plan
    assert [r.n_values for r in out.collect()] == [10] * 9
