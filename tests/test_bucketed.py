"""Bucketed tables: joins without exchange, lookups of one bucket, inserts that show at once."""

import uuid

import pytest
from pyspark.sql import functions as F

from cardwright.sources import bucketed


@pytest.fixture
def tables(spark, tmp_path):
    made = bucketed.Tables(spark, f"file://{tmp_path}", {"cards": "id", "lines": "id"}, 4, f"t{uuid.uuid4().hex}")
    yield made
    made.drop()


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_inserts_show_at_once(spark, tables, monkeypatch):
    with pytest.raises(ValueError, match="nothing was inserted"):
        tables.scan("cards")
    cards, lines = spark.range(10), spark.range(30).select((F.col("id") % 10).alias("id"), F.col("id").alias("place"))
    tables.insert({"cards": cards, "lines": lines.select("place", "id")})
    plain = bucketed.Tables._append

    def failing(self, name, rows):
        if name == "lines":
            raise OSError("disk full")
        plain(self, name, rows)

    monkeypatch.setattr(bucketed.Tables, "_append", failing)
    with pytest.raises(OSError, match="disk full"):
        tables.insert({"cards": spark.range(100, 105), "lines": lines})
    monkeypatch.undo()
    assert tables.scan("cards").count() == 10 and spark.table(tables._full("cards")).count() == 15
    tables.insert({"lines": lines.limit(0)})
    assert sorted(map(tuple, tables.scan("lines").select("id", "place").collect())) == sorted(map(tuple, lines.collect()))
    assert [r["id"] for r in tables.lookup("cards", 7).collect()] == [7] and tables.lookup("cards", 101).count() == 0
    assert tables.where("lines", F.col("id") == 3, F.col("place") > F.lit(None)).count() == 0
    with pytest.raises(ValueError, match="no such tables"):
        tables.insert({"other": cards})
    clean = bucketed.Tables(spark, tables.path + "/clean", tables.keys, 4, tables.prefix + "c")
    tables.swept("cards", clean)
    assert spark.table(clean._full("cards")).count() == 10
    clean.drop()


def test_joins_need_no_exchange(spark, tables):
    tables.insert({"cards": spark.range(50), "lines": spark.range(200).select((F.col("id") % 60).alias("id"), F.col("id").alias("place"))})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    counts = tables.scan("lines").groupBy("id").agg(F.count("*").alias("n"))
    joined = tables.scan("cards").join(counts.hint("merge"), "id", "left")
    assert "Arguments: hashpartitioning" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert joined.where("n > 0").count() == 50 and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells
    try:
        assert "SelectedBucketsCount: 1 out of 4" in plan(tables.lookup("lines", 5))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
