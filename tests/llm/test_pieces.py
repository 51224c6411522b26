import public_tokenizers
import sentencepiece

from cardwright.llm.pieces import Pieces, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "   two  spaces   ", "Hello world, it's 2024!", "line\nbreak\ttab", "日本語 é ﬁ 😀 \x00", "<s> <0x0A>", "▁ x", "ab" * 900, "Hello world, it's 2024!"]


def test_ids_and_texts_are_the_librarys(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    for r in round_trip(docs, PATH).collect():
        text = TEXTS[r["doc_id"]]
        assert r["ids"] == (None if text is None else library.encode(text))
        assert r["decoded"] == (None if text is None else library.decode(library.encode(text)))
        assert r["round_trip"] == (text is None or "▁" not in text)


def test_unigram_way_has_the_greatest_score():
    model = Pieces(PATH, unigram=True)
    ids, counts = model.encode(["theration"])

    def ways(text):
        if not text:
            yield []
        for k in range(1, len(text) + 1):
            if text[:k] in model.pieces:
                for rest in ways(text[k:]):
                    yield [model.pieces[text[:k]], *rest]

    best = max(sum(model.score[i] for i in way) for way in ways("▁theration"))
    assert sum(model.score[i] for i in ids) == best and counts.tolist() == [len(ids)]


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
