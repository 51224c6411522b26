"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns of the operators, against brute force."""

import time

import numpy as np
import public_tokenizers
import pytest
from test_text_operators import words
from tokenizers import Tokenizer

import corpus_pipeline
from cardwright.llm import chroma, hashing, queries, shared, toxicity
from cardwright.llm.decontaminate import contamination, decontaminate
from cardwright.llm.html_text import html_text, page_text
from cardwright.llm.licenses import license_scan, scan_text
from cardwright.llm.line_dedup import drop_boilerplate, host
from cardwright.llm.ngram_join import check_of, ngram_components, node_of
from cardwright.llm.transducer import token_counts, transducer

BPE = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string"


# --- pages ---

LAID_OUT = [
    ("<html><head><title>T</title><body><p>visible</p></body></html>", "visible"), ("<head><meta charset=x><p>hello", "hello"), ("<head>text<p>b", "text\n\nb"), ("<head> \n<title>x</title><script>y</script>z", "z"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
    ("<table><tr><td colspan=2>ab<td>x<tr><td>1<td>2<td rowspan=2>3<tr><td>4<td>5<tr><td>7<td>8<td>9</table>", "ab    x\n1  2  3\n4  5\n7  8  9"),
    ("<style>.x{display:none} p#y, b.z.w{visibility:hidden} .x.k{display:block}</style><p class=x>a<p>b<p class='x k'>c<p id=y>d", "b\n\nc"),
    ("<style>/* .b{display:none} */ @media print{.a{display:none}} .c{display:none}</style><p class=a>a<p class=b>b<p class=c>c", "a\n\nb"),
    ("<style>p{display:none}</style><p style='display:block'>a<p>b", "a"),
    ("a<br><br>b", "a\n\nb"), ("a<br>b<br><br><br>c", "a\nb\n\n\nc"), ("<p>a<br><br></p><p>b", "a\n\nb"), ("<br><br>a", "a"), ("<ul><li>a<br><br>b<li>c</ul>", "- a\n\n  b\n- c"),
    ("<table><tr><td>a</td></tr>text</table>", "text\n\na"), ("x<table>one<tr><td>a<td>b</tr>two<tr><td>c</table>y", "x\n\none\ntwo\na  b\nc\n\ny"),
    ("<style>div .x{display:none}</style><div><b class=x>no</b>yes<i><b class=x>no</b></i></div><b class=x>out</b>", "yes\nout"),
    ("<style>ul > li{display:none} ul li b{display:none}</style><ul><li>no</ul><ol><li>yes <b>b</b></ol>", "1. yes b"),
    ("<style>.a .b > .c{visibility:hidden}</style><p class=a><i class=b><u class=c>no</u><s><u class=c>yes</u></s></i></p>", "yes"),
    ("<style>div p{display:none} p{display:block} a + b{display:none}</style><div><p>no</div><p>yes", "yes"), ("<style>i i i{display:none}</style><i>1<i>2<i>3<i>4</i></i></i></i>", "12"),
    ("<ol><li>one<ul><li>two<p>three</ul><li>four</ol>", "1. one\n   - two\n\n     three\n\n2. four"),
]


@pytest.mark.parametrize("html,text", LAID_OUT)
def test_layout_is_kept(html, text):
    assert page_text(html) == text


def test_nested_blocks_stay_linear():
    started = time.perf_counter()
    assert len(page_text("<blockquote>a" * 3000)) < 3000 * 50 and len(page_text("<ul><li>x" * 3000)) < 3000 * 60
    assert page_text("<div><p>" * 20_000 + "x") == "x"
    assert page_text("<style>div div .x, div > p b {display:none}</style>" + "<div><p>" * 20_000 + "x<b>y") == "x"
    assert len(page_text("<table>" + "<tr><td rowspan=60000>x<td>y" * 500)) < 500 * 2 * 210
    assert time.perf_counter() - started < 20


def test_pages_null_and_repeated(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a"), (3, "<p>a")], "page_id long, html string")
    assert sorted(map(tuple, html_text(rows).select("page_id", "text").collect())) == [(1, ""), (2, ""), (3, "a"), (3, "a")]


# --- token counts ---


def test_words_of_many_chunks(spark):
    library, machine = Tokenizer.from_file(BPE), transducer(BPE)
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzéü"))
    word = lambda n: "".join(rng.choice(letters, n))
    texts = [word(4000), "a" * 5001, "ab" * 3000, f"x {word(1025)} y", "hello " * 300 + word(1500) + " z" * 400, "haha" * 900, *(" ".join(word(int(k)) for k in rng.integers(1, 1500, 5)) for _ in range(8))]
    assert machine.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    base = "thequickbrown" * 80
    one, two = machine.counts([base, base * 2]).tolist()
    started = time.perf_counter()
    assert machine.counts([base * 1000]).tolist() == [one + 999 * (two - one)]  # a megabyte without word end
    assert time.perf_counter() - started < 10
    empty = token_counts(spark.createDataFrame([], DOC), BPE)
    assert empty.count() == 0 and empty.columns[:2] == ["doc_id", "text"]


# --- licences ---


def test_many_licence_hits(spark):
    started = time.perf_counter()
    r = scan_text(b"mit license x " * 60_000)
    assert (r["n_base"], r["first_word"], r["last_word"]) == (60_000, 0, 179_997) and time.perf_counter() - started < 5
    rows = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (2, None)], DOC)
    got = sorted((r["doc_id"], r["n_base"], r["first_word"], r["labels"]) for r in license_scan(rows).collect())
    assert got == [(1, 1, 0, "cc-by"), (1, 1, 0, "cc-by"), (2, 0, None, "")]
    assert license_scan(rows.limit(0)).count() == 0


# --- lines ---


def test_lines_of_hosts_and_repeated_rows(spark):
    long = "word " * 100_000
    pages = [(f"https://www.Example.org/{i}", f"Menu\nbody {i}") for i in range(12)] + [("http://example.org:80/x", f"Menu\n{long}")] * 2 + [("plain", "Menu")]
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(pages)], "doc_id long, source string, text string")
    got = {r["doc_id"]: (r["text"], r["source"]) for r in drop_boilerplate(docs, max_ratio=0.5).collect()}
    assert got[3] == ("body 3", "https://www.Example.org/3") and got[12][0] == got[13][0] == long and got[14][0] == "Menu"
    hosts = docs.select(host(docs["source"]).alias("h")).distinct().collect()
    assert {r["h"] for r in hosts} == {"example.org", "plain"}


# --- benchmark passages ---


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], DOC), spark.createDataFrame([], "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in contamination(docs, items).collect())
    assert got == [(1, 2, 0, False), (2, 0, 0, False)]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs.limit(0), some).count() == 0 and decontaminate(docs, some).count() == 1


def test_windows_with_one_hash(spark, monkeypatch):
    """Every window gets the same hash: words still decide."""
    monkeypatch.setattr(hashing, "_run_hashes", lambda hashes, n: np.full(max(len(hashes) - n + 1, 0), 5, np.uint64))
    from cardwright.llm import decontaminate as D

    import pyarrow as pa

    rows = pa.table({"item": ["x", "y", "z"], "text": ["one two three", "TWO three four", "three one two"]}).to_batches()
    windows = D.Windows(pa.Table.from_batches(list(D._prepared(2)(iter(rows))), schema=D._ITEM))
    text = pa.array(["zero one two THREE, four"])
    hit, items = windows.find(hashing.Words(*hashing.utf8(text), 0, 1, hashing.ALNUM))
    assert hit.tolist() == [False, True, True, True, True] and items == {0: {"x", "y", "z"}}


def test_long_texts_and_blocks(spark):
    item = " ".join(f"q{i}" for i in range(14))
    docs = spark.createDataFrame([(1, "fill " * 200_000 + item), (2, item), (2, item)], DOC)
    items = spark.createDataFrame([(k, f"{item} {k}" if k else item) for k in range(6)], "item_id long, text string")
    for size in (1 << 20, 60):
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], len(r["hit_items"])) for r in contamination(docs, items, block_bytes=size).collect())
        assert got == [(1, 200_014, 14, 6), (2, 14, 14, 6), (2, 14, 14, 6)]
    assert len(words("fill " * 10)) == 10


def test_hashes_of_very_long_words():
    import pyarrow as pa

    long = "ab" * 400_000
    w = hashing.Words(*hashing.utf8(pa.array([f"{long} x {long.upper()}  {long}c"])), 0, 1, hashing.NOT_SPACE)
    a, x, b, c = w.hashes().tolist()
    assert a == b and len({a, x, c}) == 3


# --- n-gram join ---


def test_sets_with_one_fingerprint_are_told_apart(spark, monkeypatch):
    from cardwright.llm import ngram_join as J

    a, b = np.array([1, 5, 9], np.uint64), np.array([2, 5, 9], np.uint64)
    assert node_of(a) != node_of(b) and check_of(a) != check_of(b) and node_of(a, frozenset([node_of(a)])) == check_of(a)
    assert J.HOT_TOKENS * J.HOT > 0


def test_hot_tokens_are_dealt(spark, monkeypatch):
    from cardwright.llm import ngram_join as J

    monkeypatch.setattr(J, "HOT", 2)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(20)] + [(100 + i, f"other text number {i} of its own") for i in range(5)] + [(7, None)]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_components(spark.createDataFrame(rows, DOC).repartition(4)).collect()}
    assert {v for (k, n), v in got.items() if k < 20 and n} == {0} and all(v == k for (k, _), v in got.items() if k >= 100) and got[7, 0] == 7


# --- toxicity ---


def test_equal_texts_score_alike(spark):
    model = toxicity.Model(np.random.default_rng(1).normal(size=1 << toxicity.BUCKET_BITS), -0.3)
    rows = [(i, t) for i, t in enumerate(["some words here", "other", "", None, "some words here", "x " * 50_000, "some words here"])]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, DOC).repartition(1), model).collect()}
    assert got[0] == got[4] == got[6] and got[2] == got[3] == 1 / (1 + np.exp(0.3))
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, f"{'bad' if k % 2 else 'good'} word{k}") for k in range(8)] + [(1, "a text under a used id")], DOC)
    one, two = (toxicity.train(d, labels) for d in (docs, docs.repartition(7)))
    assert np.array_equal(one.weight, two.weight) and one.bias == two.bias


# --- recordings ---


def test_recordings_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 64))
    vectors = {k: base[k % 30] + rng.normal(size=64) * (0.02 if k >= 30 else 0) for k in range(60)}
    vectors |= {100: base[0], 150: base[3], 151: None}
    rows = [(k, None if v is None else [float(x) for x in v], 0) for k, v in vectors.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in queries.op5_chroma(spark, str(tmp_path)).collect()}
    assert set(got) == set(vectors) and got[151]["class_id"] is None
    media = chroma.fingerprints(chroma.sonified(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "vec_id", "embedding"))
    prints = {r["vec_id"]: np.frombuffer(bytes(r["fingerprint"]), "<u4") for r in media.collect() if len(r["fingerprint"])}
    first: dict[bytes, int] = {}
    for k in sorted(prints):
        first.setdefault(prints[k].tobytes(), k)
    own = {k: first[p.tobytes()] for k, p in prints.items()}
    assert {k: got[k]["class_id"] for k in prints} == own and got[0]["class_size"] == 2

    def nearest(a, b):
        errors = [(np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n), d) for d in range(-len(a), len(b)) for x, y in [(a[max(-d, 0) :], b[max(d, 0) :])] if (n := min(len(x), len(y))) >= chroma.OVERLAP]
        return [(e, d) for e, d in errors if e <= chroma.ERROR]

    asked = sorted({own[k] for k in prints if k % 50 == 0})
    pairs = {(q, m) for q in asked for m in set(own.values()) if q != m and nearest(prints[q], prints[m])}
    assert pairs and {(q, m) for q, m in pairs if m not in asked}
    for k in prints:
        assert got[k]["n_asked"] == sum(m == own[k] for _, m in pairs) and got[k]["n_matches"] == (sum(q == own[k] for q, _ in pairs) if k % 50 == 0 else None)
    empty = spark.createDataFrame([], "vec_id long, fingerprint binary")
    matches, members = chroma.search(empty, empty, "vec_id")
    assert matches.count() == members.count() == 0


# --- folders and the pipeline ---


def test_a_cluster_needs_its_shared_folder(monkeypatch):
    class Conf(dict):
        def getConf(self):
            return self

    class Session:
        conf, sparkContext = Conf(), Conf()

    Session.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session, "x")
    Session.sparkContext.master = "local[2]"
    assert shared.shared_dir(Session, "x").startswith("file://")


def test_tables_are_dropped(spark):
    with shared.tables_dropped(spark):
        gone, kept = shared.written(spark.range(3), "gone"), shared.written(spark.range(4), "kept", keep=True)
        paths = gone.inputFiles()
        assert gone.count() == 3
    assert kept.count() == 4 and not spark._jvm.java.io.File(paths[0].removeprefix("file://").removeprefix("file:")).exists()


def test_stages_keep_columns_and_take_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(30).selectExpr("*", "1 AS n_hit", "'x' AS ids", "2 AS node", "3 AS score", "4 AS n_lines")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.count() <= 30 and stage(spark, docs.limit(0), d).count() == 0
        if name != "sentencepiece":
            assert out.columns == docs.columns
    assert {"n_hit", "node", "score"} <= set(out.columns) and "round_trip" in out.columns


def test_table_of_hashes_grows():
    rng, table, known = np.random.default_rng(0), hashing.Memo(4), []
    for n in (3, 0, 500, 20_000):
        new = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        table.add(new)
        known.append(new)
    known = np.concatenate(known)
    assert (table.find(known) == np.arange(len(known))).all() and (table.find(rng.integers(0, 2**64, 1000, dtype=np.uint64)) < 0).all()
    assert 2 * table.n <= 1 << table.bits
