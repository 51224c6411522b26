"""The ranked search against a plain ranking of every document for every item."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cardwright.llm import ranked_search
from cardwright.llm.ranked_search import Graph, search

DOC, ITEM = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    counted = [(d, Counter(WORD.findall((t or "").translate(FOLD)))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_words = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(WORD.findall((t or "").translate(FOLD)))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in counted:
            m = 50 + 50 * c.total() * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        out += [(i, r, d if there else None, -s) for r, (s, there, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    return sorted(map(tuple, search(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), **options).collect()), key=str)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünter", "ünter", "x9", "ÉT"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(2, docs[2][1])]  # copies, and a repeated row
    docs += [(500, None), (501, ""), (502, " .,\n"), (None, docs[3][1]), (None, docs[3][1]), (503, "W1 w1-W1_ünter"), (-4, docs[3][1])]
    docs += [(600, "w1 w2, " * 60_000 + "z" * 300_000 + " w3"), (601, "w5" + "z" * 700_000)]
    items = [(i, text(12)) for i in range(20)] + [(50, items_text := "w1 w2 w3 Ünter"), (51, items_text + " w4"), (52, items_text), (53, None), (54, "?"), (55, "never seen"), (None, "w1"), (3, "w59 more")]
    return docs, items


def test_equals_plain_ranking(spark, tables):
    docs, items = tables
    for k in (5, 500):
        assert found(spark, docs, items, k=k) == plain(docs, items, k)


def test_blocks_of_items_and_of_accumulators(spark, tables, monkeypatch):
    docs, items = tables
    assert found(spark, docs, items, k=7, block_bytes=200) == plain(docs, items, 7)
    monkeypatch.setattr(ranked_search, "HELD", 300)
    monkeypatch.setattr(ranked_search, "CANDIDATES", 10)
    assert found(spark, docs, items, k=7) == plain(docs, items, 7)


def test_nothing_to_rank(spark, tables):
    docs, items = tables
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], [(1, "?")]) == []


def test_names_of_other_columns_do_not_matter(spark, tables):
    docs, items = tables
    rows = spark.createDataFrame([(*d, "x", 1.5, 2) for d in docs], DOC + ", item_id string, score double, rank int")
    asked = spark.createDataFrame([(*i, 7) for i in items], ITEM + ", doc_id int")
    assert sorted(map(tuple, search(rows, asked, k=5).collect()), key=str) == plain(docs, items, 5)


def test_shared_terms_are_added_once():
    terms = [["a", "b", "c", "d"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], ["a", "b", "f"], [], ["f"]]
    graph = Graph(list(range(6)), terms)
    assert graph.additions() < sum(max(len(t) - 1, 0) for t in terms) - 4
    values = np.random.default_rng(1).integers(0, 10**9, (len(graph.terms), 11))
    for i, row in enumerate(graph.scores(values)):
        assert (row == sum((values[graph.terms.index(t)] for t in terms[i]), np.zeros(11, np.int64))).all()


@pytest.mark.parametrize("seed", range(5))
def test_graph_of_random_items(seed):
    rng = np.random.default_rng(seed)
    terms = [sorted({f"t{int(x)}" for x in rng.zipf(1.3, 30) if x < 200}) for _ in range(40)]
    graph = Graph(list(range(40)), terms)
    values = rng.integers(0, 10**9, (len(graph.terms), 3))
    want = np.array([values[[graph.terms.index(t) for t in x]].sum(0) for x in terms])
    assert (graph.scores(values) == want).all()
