"""Every registered query of the library itself against its SQL in DuckDB, at the smallest size."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from cardwright.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)


def test_queries_without_sql_give_rows(spark):
    for name in ("formal_patterns", "template_match", "heuristic_units", "rk4_simulate", "codegen_package"):
        assert catalogue.QUERIES[name](spark, D).limit(1).count() == 1


def test_every_supplier_is_fitted(spark):
    keys = {r[0] for r in spark.read.parquet(f"{D}/supplier.parquet").select("s_suppkey").collect()}
    got = {r["series_id"]: r["mumax"] for r in catalogue.QUERIES["monod_fit"](spark, D).collect()}
    assert set(got) == keys and len(keys) > 4
    assert all(abs(v - (0.4 + k % 4 * 0.05)) < 0.01 for k, v in got.items())


def test_every_benchmark_item_is_scored(spark, tmp_path):
    texts = [f"word{k} other{k} more{k}" for k in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for n in (7, 90):
        folder = tmp_path / str(n)
        folder.mkdir()
        (folder / "benchmark.parquet").symlink_to(tmp_path / "benchmark.parquet")
        spark.createDataFrame([(k, 0, texts[k % 60]) for k in range(n)], "conv_id long, turn int, text string").write.parquet(f"{folder}/conversations.parquet")
        got = catalogue.QUERIES["recall_cover"](spark, str(folder)).collect()
        assert {r["item_id"] for r in got} == set(range(60)) and {r["conv_id"] for r in got} == set(range(n))
        assert all((r["jaccard"], r["recall"]) == ((1.0, 1.0) if r["item_id"] == r["conv_id"] % 60 else (0.0, 0.0)) for r in got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
