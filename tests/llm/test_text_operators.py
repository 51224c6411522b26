"""Operators on texts against brute force, on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardwright.llm import ngram_join as J
from cardwright.llm import queries, toxicity
from cardwright.llm.decontaminate import contamination, decontaminate
from cardwright.llm.licenses import evaluate, license_scan, parse
from cardwright.llm.line_dedup import drop_boilerplate
from cardwright.llm.transducer import token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = queries.QUERIES[name](spark, d)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if sets[i]:
            least[root(i)] = min(least.get(root(i), k), k)
    return Counter((k, len(sets[i]), least.get(root(i), k)) for i, (k, _) in enumerate(rows))


def near_copies(seed, n, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, len(w), edits):
            w[at] = f"e{rng.integers(0, 10_000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("family", [48, 3])
def test_jaccard_join_is_exact(spark, monkeypatch, family):
    monkeypatch.setattr(J, "FAMILY", family)
    monkeypatch.setattr(J, "BLOCK", 8)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [*near_copies(1, 30, 3), *near_copies(2, 12, 1), "one two", "ONE  two", "one two three", None, "", " \t\n", "same words here five six", "same words here five six", *[f"{passage} {' '.join(f'u{i}_{k}' for k in range(40))}" for i in range(25)], "x " * 30_000]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (99, "another text under a used id")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, node int").repartition(5)
    assert Counter(map(tuple, J.ngram_components(docs).collect())) == brute_components(rows)


def test_families_are_written_once_and_thin_tokens_learnt(spark, monkeypatch):
    """Texts of few sentences in new orders: every token is shared, so they are one family if the orders do not know the tokens' numbers."""
    rng = np.random.default_rng(3)
    sentences = [" ".join(f"s{i}_{k}" for k in range(12)) for i in range(40)]
    texts = [" ".join(sentences[i] for i in rng.permutation(40)[:8]) + " " + " ".join(f"u{d}_{k}" for k in range(30)) for d in range(120)]
    rows = list(enumerate([*texts, *near_copies(5, 20, 2)]))
    made = defaultdict(list)
    written = J.written

    def kept(df, name, *more, **options):
        made[name].append(written(df, name, *more, keep=True))
        return made[name][-1]

    monkeypatch.setattr(J, "written", kept)
    for name, value in {"KNOWN_SHINGLES": 1, "FAMILY": 3, "BLOCK": 8, "THIN": 2, "LOCAL_COUNT": 1_000}.items():
        monkeypatch.setattr(J, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(J, "RELEARNT", 0)
    assert Counter(map(tuple, J.ngram_components(docs).collect())) == brute_components(rows)
    packed = made["blocks"][0].selectExpr("explode(sets.node) AS node")
    assert packed.count() == packed.distinct().count() == made["members"][0].count() > 8  # each set in one block only
    members = made["members"][0].count()
    made.clear()
    monkeypatch.setattr(J, "RELEARNT", 6)
    assert Counter(map(tuple, J.ngram_components(docs).collect())) == brute_components(rows)
    assert sum(x.count() for x in made["members"]) < members / 2  # unrelated texts are no family any more


def test_postings_meet_their_tokens_without_outer_joins(spark):
    """Hot tokens' postings are joined where they lie; all others by token; no posting is joined only to learn whether its token is hot."""
    posts = spark.createDataFrame([(t, n) for t in range(20) for n in range(200 if t == 3 else t)], "token long, node long")
    per_token = spark.createDataFrame([(t, -t) for t in range(0, 20, 3)], "token long, c long")
    hot = spark.createDataFrame([(3,), (4,)], "token long")
    joined = J.by_token(posts, per_token, hot)
    assert Counter(map(tuple, joined.collect())) == Counter(map(tuple, posts.join(per_token, "token").collect()))
    assert "LeftOuter" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_jaccard_join_of_nothing(spark):
    assert J.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contamination(spark):
    item = " ".join(f"q{i}" for i in range(20))
    items = [(1, item), (2, "Short one"), (2, "Short one"), (3, None), (4, "..."), (10, " ".join(f"Q{i}" for i in range(5, 18)))]
    texts = [f"Before {item.upper()}; after", "a SHORT-one, b", "short", None, "", "q0 q1 q2", " ".join(f"q{i}" for i in range(13)) + " fill" * 300, "short one " * 3]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(k))
    want = {}
    for i, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for key, names in windows.items():
            for s in range(len(w) - len(key) + 1):
                if tuple(w[s : s + len(key)]) == key:
                    hit |= set(range(s, s + len(key)))
                    ids |= names
        want[i] = (len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w))
    for limit in (1 << 20, 40):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["hit_items"], r["contaminated"]) for r in contamination(docs, bench, block_bytes=limit).collect()}
        assert got == want
    left = {r["doc_id"]: r for r in decontaminate(docs, bench).collect()}
    assert set(left) == {i for i, x in want.items() if not x[3]} and not set(words(left[6]["text"])) & {"q0", "q12"} and left[6]["n_hit"] == 7


def test_licenses(spark):
    texts = ["The MIT License. mit-license (c); CC BY cc by 4.0", "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0\nx", "GNU General Public License" * 2, None, "", "apache  license " * 3, "ccby gnu general public licenses", "SPDX-License-Identifier: AND"]
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in license_scan(docs).collect():
        w = words(texts[r["doc_id"]])
        places = [(s, label) for p, label in phrases.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        base = sorted({x for _, x in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(base))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(base) <= set(r["labels"].split(",") if r["labels"] else []) and 0 <= r["score"] <= 1
        if r["doc_id"] == 1:
            assert r["labels"].split(",") == ["spdx:apache-2.0", "spdx:gpl-2.0", "spdx:mit"] and r["expressions"][0]["duty"] == 1
    assert parse("MIT OR Apache-2.0 AND GPL-2.0 WITH x") == ["MIT", "Apache-2.0", "GPL-2.0", "x", "WITH".lower(), "and", "or"]
    assert parse("(MIT") is None and parse("OR MIT") is None and parse("MIT */ text") == ["MIT"]
    assert evaluate(parse("MIT OR GPL-3.0")) == ({"mit", "gpl-3.0"}, 1) and evaluate(parse("MIT AND GPL-3.0"))[1] == 2


def test_token_counts(spark):
    texts = ["it's 'sam they're''s !'s we'll I'd", "<|startoftext|>a<|endoftext|> <|ENDOFTEXT|>", "ΣΑΣ Éé 日本 ١٢ ½ 😀\x1c\x85﻿", None, "", "a" * 3000, "fill " * 3000]
    rng = np.random.default_rng(3)
    texts += ["".join(chr(c) for c in rng.choice([*range(32, 127), *range(0xC0, 0x250), *range(0x300, 0x340), 0x4E2D, 0x1F600], 200)) for _ in range(60)]
    library = Tokenizer.from_file(BPE)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in token_counts(docs, BPE).collect():
        t = texts[r["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_line_dedup(spark):
    pages = [("a", f"Menu\nbody {i}\n\n  Foot \nbody {i}") for i in range(20)] + [("b", f"Menu\nother {i}") for i in range(3)] + [("a", None), ("a", ""), (None, "Menu"), ("a", "Menu\nFoot")]
    docs = spark.createDataFrame([(i, s, t, "x") for i, (s, t) in enumerate(pages)], "doc_id long, source string, text string, n_lines string")
    got = {r["doc_id"]: r for r in drop_boilerplate(docs, max_ratio=0.5).collect()}
    assert got[0]["text"] == "body 0\n\nbody 0" and (got[0]["_n_lines"], got[0]["n_dropped"], got[0]["n_lines"]) == (5, 2, "x")
    assert got[20]["text"] == "Menu\nother 0" and got[23]["text"] is None and got[24]["text"] == "" and got[25]["text"] == "Menu" and got[26]["text"] == ""
    # a page of boilerplate only stays whole if an equal page is there
    assert {r["doc_id"]: r["text"] for r in drop_boilerplate(docs, max_ratio=0.5, spare_copies=True).collect()}[26] == ""
    twice = docs.union(docs.where("doc_id = 26"))
    assert {r["doc_id"]: r["text"] for r in drop_boilerplate(twice, max_ratio=0.5, spare_copies=True).collect()}[26] == "Menu\nFoot"
    assert drop_boilerplate(docs.limit(0)).count() == 0


def test_toxicity_generalises(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    rows = toxicity.score(docs, model).join(labels, "doc_id").select("doc_id", "toxic", "score").collect()
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in out)
    assert right / len(out) > 0.95 and min(r["score"] for r in out if r["toxic"] == 1) > np.median([r["score"] for r in out])
    assert model.words(["idiot"])[0] > 5 and model.words(["idiott"])[0] > 1 > abs(model.words(["the"])[0])
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "...", 3)], "doc_id long, text string, score int")
    assert len({r["score"] for r in toxicity.score(odd, model).collect()}) == 1
    none = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score(odd, none).count() == 3


def test_items_digest(spark):
    r = queries.op9_decontaminate(spark, "/root/testdata/sf0.001").where("n_items = 0").first()
    assert r["items_sha256"] == hashlib.sha256(b"").hexdigest()
