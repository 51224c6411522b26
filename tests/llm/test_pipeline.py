"""The pipeline against plain Python, stage by stage."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from test_text_operators import brute_components, words

import corpus_pipeline
from cardwright.llm import toxicity

D = "/root/testdata/sf0.001"


def plain_run(spark):
    read = lambda t: spark.read.parquet(f"{D}/{t}.parquet")
    docs = {r["doc_id"]: r.asDict() for r in read("documents").collect()}
    model = toxicity.train(read("documents"), read("labels").where(~toxicity.held_out()))

    def score(text):
        w = [x.lower() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        # upper case outside ASCII keeps its own hash but is folded before its n-grams are taken
        return 1 / (1 + np.exp(-(model.bias + (toxicity.GAIN * model.words(w).mean() if w else 0))))

    docs = {k: d for k, d in docs.items() if score(d["text"]) < 0.5}
    pages, lines = Counter(d["source"] for d in docs.values()), Counter()
    for d in docs.values():
        lines.update({(d["source"], x.strip(" \t\r")) for x in (d["text"] or "").split("\n")})
    for d in docs.values():
        bad = lambda x: x.strip(" \t\r") and lines[d["source"], x.strip(" \t\r")] >= 5 and lines[d["source"], x.strip(" \t\r")] > 0.05 * pages[d["source"]]  # noqa: B023, E731
        kept = [x for x in d["text"].split("\n") if not bad(x)]
        if any(x.strip(" \t\r") for x in kept):
            d["text"] = "\n".join(kept)
    firsts = {k for k, _, c in brute_components([(k, d["text"]) for k, d in docs.items()]) if k == c}
    docs = {k: d for k, d in docs.items() if k in firsts}
    windows = set()
    for r in read("benchmark").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + min(13, len(w))]) for i in range(len(w) - min(13, len(w)) + 1)} if w else set()
    sizes, out = {len(x) for x in windows}, {}
    for k, d in docs.items():
        w, hit = words(d["text"]), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
        if not (hit and 20 * len(hit) >= len(w)):
            assert not hit  # no passage is short enough to be cut at this size
            out[k] = d
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {(k, len(d["text"]), tuple(library.encode(d["text"]))) for k, d in out.items()}


def test_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, D).collect()
    assert all(r["round_trip"] for r in got)
    assert {(r["doc_id"], r["n_chars"], tuple(r["ids"])) for r in got} == plain_run(spark)


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", "en", "s", 11), (3, None, "en", None, 0), (None, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_copies_out(spark, docs, D)
    assert left.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in left.collect()))) == ["1", "3", "None"]


def test_pages_of_boilerplate_only_are_cut_unless_equal_copies(spark):
    menu = [f"menu entry number {k} of this site" for k in range(6)]
    pages = {k: "\n".join(menu[j] for j in range(6) if j not in (k % 6, (k // 6 + k + 1) % 6)) for k in range(12)}
    assert len(set(pages.values())) == 12
    pages |= {k: "the same notice\n\non every one of these pages" for k in range(20, 26)} | {k: f"a page with its own words {k}\n{menu[0]}" for k in range(30, 50)}
    rows = [(k, t, "en", s, len(t)) for s in ("a", None) for k, t in ((k + (100 if s else 0), t) for k, t in pages.items())]
    rows += [(900, "", "en", "a", 0), (901, None, "en", "a", 0), (902, " \n ", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.boilerplate_out(spark, docs, D)
    assert got.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in got.collect()}
    assert len(got) == len(rows) and (got[900], got[901], got[902]) == ("", None, " \n ")
    for k, t in pages.items():
        want = "" if k < 12 else t if k < 30 else t.split("\n")[0]
        assert (got[k], got[k + 100]) == (want, want)
    left = {r["doc_id"] for r in corpus_pipeline.near_copies_out(spark, docs.where("doc_id BETWEEN 20 AND 25"), D).collect()}
    assert left == {20}
