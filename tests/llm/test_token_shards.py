import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardwright.llm import token_shards as S
from cardwright.llm import wavelet
from cardwright.llm.shared import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5, 1), (511, 3), (512, 40), (5000, 49408), (3000, 7)])
def test_wavelet_round_trip_and_lookups(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint16)
    w = wavelet.WaveletMatrix(wavelet.build(ids, np.array([4]), np.array([n])))
    assert w.decode().tolist() == ids.tolist()
    if n:
        assert w.access(np.arange(n)).tolist() == ids.tolist()
    for token in {*ids[:20].tolist(), top + 1}:
        places = np.flatnonzero(ids == token)
        assert w.occurrences(token).tolist() == places.tolist()
        assert w.count(token) == len(places)
        assert w.count(token, n // 3, 2 * n // 3) == int((ids[n // 3 : 2 * n // 3] == token).sum())


def test_files_hold_what_the_library_gives(spark):
    texts = {9: "Hello  WORLD it's", 3: None, 7: "", 1: "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>", 12: "é é  x\x1cy 日本 ' 's 123", 4: "word " * 3000, 5: "same", 8: "same"}
    docs = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()], "doc_id long, text string, part string").repartition(3)
    path = shared_dir(spark, "t")
    S.write_shards(docs, path, PATH, 2, shard_tokens=50)
    library, start, want, everything = Tokenizer.from_file(PATH), 0, [], []
    for k in sorted(texts):
        ids = [*library.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        everything += ids
    assert sorted(map(tuple, S.document_digests(spark, path).collect())) == want
    asked = [0, 1, 5, len(everything) - 1, 40]
    assert sorted(map(tuple, S.tokens_at(spark, path, spark.createDataFrame([(i,) for i in asked], "position long")).collect())) == [(i, everything[i]) for i in sorted(asked)]
    token = everything[-5]
    assert [r[0] for r in S.token_occurrences(spark, path, token).orderBy("position").collect()] == [i for i, x in enumerate(everything) if x == token]
    assert S.count_token(spark, path, token).first()[0] == everything.count(token)


def test_empty_table(spark):
    path = shared_dir(spark, "t")
    S.write_shards(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 2)
    assert S.document_digests(spark, path).count() == 0
