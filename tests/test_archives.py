"""Archives written by tasks: committed whole or not at all."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from cardwright.sources import archives
from cardwright.sources.archives import read_archives, write_archives


def cards(spark, first, last):
    rows = spark.range(first, last).select(F.col("id").alias("extraction_id"), F.explode(F.sequence(F.lit(1), F.col("id") % 4 + 1)).alias("k"))
    return rows.select("extraction_id", F.concat(F.lit("f"), "k", F.lit(".txt")).alias("filename"), F.when(F.col("k") < 4, F.concat(F.lit("é "), F.col("extraction_id") * F.col("k"))).alias("content"))


def told(frame):
    return sorted(map(tuple, frame.collect()))


def test_all_cards_come_back(spark, tmp_path):
    path, made = str(tmp_path / "out"), cards(spark, 0, 40)
    os.makedirs(path)
    write_archives(made, path)
    assert sorted(os.listdir(path)) == sorted(f"{k}.zip" for k in range(40))
    want = told(made.select(F.col("extraction_id").cast("string"), "filename", F.coalesce("content", F.lit(""))))
    assert told(read_archives(spark, path)) == want
    with zipfile.ZipFile(f"{path}/7.zip") as book:
        assert book.namelist() == [f"model_package/f{k}.txt" for k in range(1, 5)] and book.read("model_package/f2.txt").decode() == "é 14"
    before = {k: (tmp_path / "out" / k).read_bytes() for k in os.listdir(path)}
    write_archives(made, path, overwrite=True)
    assert before == {k: (tmp_path / "out" / k).read_bytes() for k in os.listdir(path)}  # the same bytes, nothing else
    write_archives(cards(spark, 50, 52), path)
    assert len(os.listdir(path)) == 42


def test_nothing_is_left_of_a_failed_job(spark, tmp_path):
    path = str(tmp_path)
    write_archives(cards(spark, 0, 4), path)
    bad = cards(spark, 10, 60).withColumn("content", F.when(F.col("extraction_id") == 59, F.raise_error(F.lit("no text"))).otherwise(F.col("content")))
    for frame in (bad, cards(spark, 3, 9), cards(spark, 100, 140).withColumn("extraction_id", F.when(F.col("extraction_id") == 120, "../x").otherwise(F.col("extraction_id").cast("string")))):
        with pytest.raises(Exception, match="no text|there already|no name"):
            write_archives(frame, path)
        assert sorted(os.listdir(path)) == [f"{k}.zip" for k in range(4)]


def test_a_task_that_runs_twice_counts_once(tmp_path):
    writer = archives._Writer(str(tmp_path), "", False)
    rows = [{"archive": "a", "filename": "x", "content": "1"}, {"archive": "a", "filename": "y", "content": None}, {"archive": "b", "filename": "x", "content": "2"}]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    assert os.listdir(tmp_path) == ["_pending"] and len(lost.archives) == len(kept.archives) == 2
    writer.commit([kept, None])
    assert sorted(os.listdir(tmp_path)) == ["a.zip", "b.zip"]
    split = archives._Writer(str(tmp_path), "", True)
    with pytest.raises(ValueError, match="several tasks"):
        split.commit([split.write(iter(rows)), split.write(iter(rows))])
    assert sorted(os.listdir(tmp_path)) == ["a.zip", "b.zip"]
