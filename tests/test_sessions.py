"""Sessions and upserts as streams."""

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cardwright.sources.bucketed import Tables
from cardwright.streaming import sessions

START = datetime(2024, 1, 1)
SETTINGS = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")


def test_sessions_end(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "sid string, at timestamp, action string, sess string"
    sessions.prepare(spark)

    def batch(*rows):
        spark.createDataFrame([(sid, START + timedelta(days=day), action, sess) for sid, day, action, sess in rows], schema).coalesce(1).write.mode("append").parquet(path)
        answers = sessions.session_reads(spark.readStream.schema(schema).parquet(path))
        query = answers.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(60)
        return sorted((r["sid"], (r["at"] - START).days, r["valid"], r["sess"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = batch(("a", 0, "write", "one"), ("a", 7, "read", None), ("b", 1, "read", None), ("c", 0, "write", "x"), ("c", 1, "delete", None), ("c", 1, "read", None), (None, 0, "write", "y"), ("d", 0, "write", "d"))
    assert first == [("a", 7, True, "one"), ("b", 1, False, None), ("c", 1, False, None)]
    second = batch(("a", 8, "read", None), ("a", 7, "read", None), ("d", 6, "write", "new"), ("d", 12, "read", None), ("d", 14, "read", None), ("d", 13, "read", None))
    assert [r for r in second if r not in first or r == ("a", 7, True, "one")] == [("a", 7, True, "one"), ("a", 7, True, "one"), ("a", 8, False, None), ("d", 12, True, "new"), ("d", 13, True, "new"), ("d", 14, False, None)]
    third = batch(("a", 7, "read", None), ("d", 13, "read", None))  # what was read too late is gone
    assert ("a", 7, False, None) in third and ("d", 13, False, None) in third
    for name in SETTINGS:
        spark.conf.unset(name)


def test_batches_count_once(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/tables", {"users": "id"}, 2, f"t{uuid.uuid4().hex}")
    path, schema = str(tmp_path / "in"), "id long, email string, seen long"

    def batch(checkpoint, *rows):
        if rows:
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)
        sessions.upserts(spark.readStream.schema(schema).parquet(path), tables, "users", str(tmp_path / checkpoint)).awaitTermination()
        return sorted(map(tuple, sessions.current(tables, "users", "seen").select("id", "email").collect()))

    assert batch("a", (1, "one", 1), (2, "two", 1), (2, "second", 2)) == [(1, "one"), (2, "second")]
    assert batch("a", (1, "new", 0), (3, "three", 0)) == [(1, "new"), (2, "second"), (3, "three")]
    n = tables.scan("users").count()
    assert tables.insert({"users": spark.createDataFrame([(9, "again", 1, 0)], "id long, email string, seen long, version long")}, tag="upserts-0") is None
    assert tables.scan("users").count() == n == 5 and tables.scan("users").where(F.col("id") == 9).isEmpty()
    tables.drop()
