import json

from pyspark.sql import functions as F

from cardwright.operators import projects
from cardwright.sources import sinks


def test_csv_and_json_forms(spark):
    rows = spark.createDataFrame([(1, 2, "b", 'say "x", y'), (1, 1, "a", " z ")], "id long, ordinal int, symbol string, name string")
    assert sinks.csv_lines(rows, "id", "ordinal", ("symbol", "name")).first()["content"] == 'symbol,name\na,z\nb,"say ""x"", y"'
    points = spark.createDataFrame([(1, 0.1, 2.0, 3.0), (1, 0.0, 1.0, 4.0)], "id long, t double, X double, S double")
    lines = sinks.simulation_csv(points).first()["content"].split("\n")
    assert lines[3:] == ["", "time_h,X_g_per_L,S_g_per_L", "0.0000,1.0000,4.0000", "0.1000,2.0000,3.0000"] and all(x.startswith("#") for x in lines[:3])
    fits = spark.createDataFrame([(1, *map(float, range(7)))], "series_id long, " + ", ".join(f"{c} double" for c in sinks.FIT_COLUMNS))
    assert sinks.fit_csv(fits).first()["content"].split("\n")[1] == "mumax,0.000000"
    assert json.loads(sinks.fit_json(fits).first()["content"])["metrics"]["r2_S"] == 6.0


def test_wrapping(spark):
    text = " ".join(f"word{i}" for i in range(40))
    out = spark.createDataFrame([(text,)], "t string").select(sinks.wrapped("t").alias("w")).first()["w"].split("\n")
    assert all(len(x) <= 88 and x.startswith("# ") for x in out) and " ".join(x[2:] for x in out) == text


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("mock", "a", 0.5), ("mock", "b", 0.7)], "provider string, fixture string, overall double")
    sinks.write_report(rows, rows.groupBy("provider").agg(F.avg("overall").alias("overall")), f"{tmp_path}/r")
    r = spark.read.json(f"{tmp_path}/r").first()
    assert len(r["fixtures"]) == 2 and round(r["means"]["overall"], 6) == 0.6


def test_new_projects(spark):
    now = F.timestamp_seconds(F.lit(0))
    made = projects.created(spark.createDataFrame([(1, "p", None)], "id long, name string, description string"), "u", now).first()
    assert (made["owner_id"], made["visibility"], made["description"]) == ("u", "private", "")
    assert projects.created(spark.createDataFrame([(1, "p", None)], "id long, name string, description string"), None, now).first()["visibility"] == "public"
