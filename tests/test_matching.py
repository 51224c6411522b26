"""The automaton of many words against plain searches."""

import numpy as np

from cardwright.functions.matching import Automaton, found_words, word_counts


def test_places_and_counts():
    rng = np.random.default_rng(4)
    for _ in range(60):
        text = "".join(rng.choice(list("abä "), 80))
        words = ["".join(rng.choice(list("abä "), int(rng.integers(1, 5)))) for _ in range(12)] + ["", "zzz"]
        machine = Automaton(words)
        assert {machine.words[k] for k in machine.found(text)} == {w for w in words if w and w in text}
        assert machine.counts(text) == {w: text.count(w) for w in words if w and w in text}
        assert sorted((machine.words[w], end) for w, end in machine.places(text)) == sorted((w, i + len(w)) for w in {*words} - {""} for i in range(len(text)) if text.startswith(w, i))


def test_nothing_to_find():
    assert Automaton([]).counts("abc") == {} and Automaton(["a"]).counts("") == {} and Automaton(["aa"]).counts("aaaaa") == {"aa": 2}


def test_tables(spark):
    texts = spark.createDataFrame([(1, "monod and monod growth"), (2, None), (3, "growth"), (4, "")], "id long, text string")
    words = spark.createDataFrame([("mono",), ("growth",), ("row",), ("yield",), ("",)], "word string")
    for block in (1 << 20, 5):
        assert sorted(r[0] for r in found_words(texts, words, block_chars=block).collect()) == ["growth", "mono", "row"]
        got = sorted((r["id"], r["word"], r["n"]) for r in word_counts(texts, words, block_chars=block).collect())
        assert got == [(1, "growth", 1), (1, "mono", 2), (1, "row", 1), (3, "growth", 1), (3, "row", 1)]
    none = words.limit(0)
    assert found_words(texts, none).count() == 0 and word_counts(texts.limit(0), words).count() == 0
