"""Time-series files through the data source, cut anywhere, against the reader of whole files."""

import pytest
from pyspark.sql import functions as F

from cardwright.sources import series_csv, series_source

HEAD = "time,X,S,O2\n"
ROWS = "".join(f"{k},{k / 2},{10 - k / 3:.3f},{k}\n" for k in range(8))
FILES = {
    "plain.csv": HEAD + ROWS, "crlf.csv": (HEAD + ROWS).replace("\n", "\r\n"), "cr.csv": (HEAD + ROWS).replace("\n", "\r").rstrip("\r"), "comments.csv": "# a\n\n  # b\n" + HEAD.replace(",", " , ") + "#c\n" + ROWS + "\n\n",
    "odd.csv": "t,x,s,do,co2\n0,1,2\n0,1,2\nx,1,2\n1,-3,4,nope\n2,1\n3,1e999,2\n 4 , 1.5abc , -2 \n5,1,1\n6,1,1\n2,9,9\n7,1,1\n", "headless.csv": "a,b\n1,2\n", "one.csv": "time,X,S\n", "empty.csv": "", "blank.csv": " \n\t\n#x", "ünï.csv": HEAD + "µ,1,2\n" + ROWS,
    "long_line.csv": HEAD + ROWS + "9,1,1," + "z" * 5000 + "\n10,1,1\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("series")
    for name, text in FILES.items():
        (path / name).write_bytes(text.encode())
    (path / "_hidden.csv").write_text("time,X,S\n")
    (path / "below").mkdir()
    (path / "below" / "many.csv").write_text(HEAD + "".join(f"{k},1,1,1\n" for k in range(10_040)))
    return path


def told(tables):
    name = F.element_at(F.split(F.try_url_decode("file_id"), "/"), -1).alias("file")
    return [sorted((tuple(r) for r in t.select(name, *(c for c in t.columns if c != "file_id")).collect()), key=str) for t in tables]


@pytest.mark.parametrize("part_bytes", [20_000])
def test_equals_whole_files(spark, folder, part_bytes):
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(str(folder), wholetext=True).select(F.input_file_name().alias("file_id"), F.col("value").alias("content")).where(~F.col("file_id").contains("_hidden"))
    want = told(series_csv.parse(whole.persist()))
    got = told(series_source.parse(series_source.read(spark, str(folder), part_bytes).persist()))
    empty = ("empty.csv",)  # whole-text reading may leave a file of no bytes out
    for a, b in zip(want, got, strict=True):
        assert [r for r in a if r[:1] != empty] == [r for r in b if r[:1] != empty]
    assert ("empty.csv", False, 0) in got[2]


def test_every_cut_gives_each_line_once(tmp_path):
    data = b"\r\na\nbb\r\n\r\rccc\n\ndddd\nlast"
    (tmp_path / "x").write_bytes(data)
    want = [x for x in data.replace(b"\r", b"\n").split(b"\n") if x]
    for size in range(1, len(data) + 2):
        got = [(at, x) for p in series_source.parts(series_source.found_files(str(tmp_path)), size) for at, x in series_source.lines(p) if x]
        assert [x for _, x in got] == want and all(data[at : at + len(x)] == x for at, x in got)


def test_very_long_lines_are_cut(tmp_path, monkeypatch):
    monkeypatch.setattr(series_source, "LINE_BYTES", 100)
    monkeypatch.setattr(series_source, "BUFFER", 64)
    (tmp_path / "x").write_bytes(b"short\n" + b"y" * 1000 + b"\nnext\n")
    for size in (50, 333, 5000):
        got = [x for p in series_source.parts(series_source.found_files(str(tmp_path)), size) for _, x in series_source.lines(p)]
        assert got == [b"short", b"y" * 100, b"next"]


def test_stream_of_files(spark, tmp_path):
    data, seen = tmp_path / "in", []
    data.mkdir()
    (data / "a.csv").write_text(FILES["plain.csv"])

    def handle(rows, messages, status):
        seen.append((sorted(r["file_id"].split("/")[-1] for r in status.collect()), rows.count(), messages.count()))

    query = series_source.follow(spark, str(data), handle, str(tmp_path / "checkpoint"), part_bytes=50)
    query.processAllAvailable()
    (data / "b.csv").write_text(FILES["odd.csv"])
    query.processAllAvailable()
    query.stop()
    want = series_csv.parse(spark.createDataFrame([("b", FILES["odd.csv"])], "file_id string, content string"))
    assert [s for s in seen if s[0]] == [(["a.csv"], 8, 0), (["b.csv"], want[0].count(), want[1].count())]
    again = series_source.follow(spark, str(data), handle, str(tmp_path / "checkpoint"))
    again.processAllAvailable()
    again.stop()
    assert sum(len(s[0]) for s in seen) == 2
