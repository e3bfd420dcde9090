import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataloom.llm.tokens import Encoder, token_table
from strataloom.llm.wavelet import WaveletMatrix

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_wavelet_round_trip_rank_select(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 49_407).astype(np.uint32)
    held = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
    assert (held.ids() == ids).all()
    for at in r.integers(0, n, 30) if n else []:
        value = int(ids[at])
        places = np.flatnonzero(ids == value)
        k = int(np.searchsorted(places, at))
        assert held.access(int(at)) == value and held.find(value, k) == at
        assert held.count(value) == len(places) and held.count(value, 0, int(at)) == k
    assert held.count(65_535) == 0
    if n:
        with pytest.raises(IndexError):
            held.find(int(ids[0]), n)
    with pytest.raises(ValueError):
        WaveletMatrix.build(np.array([1 << 16]))


ODD = ["", " \n", "Hello, WORLD... it's I'll x.!", "ñandú ÉTÉ straße", "a\x85b c d e", "ΑΣ ΟΔΟΣ", "<|endoftext|> hi <|startoftext|>x a<|endoftext|>", "é İstanbul ﬁ Ω", "日本語 テスト 1234 12a3 ---", "ŉo Łó _x_ a_b $$$ w$$$"]


def test_words_encode_like_whole_texts():
    whole, own = Tokenizer.from_file(PATH), Encoder(PATH, 1)
    for text in ODD:
        ids, sizes = own.encode([text])
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids + [1] and sizes.tolist() == [len(ids)]


def test_table_read_back(spark):
    r = random.Random(6)
    data = [(d, " ".join(r.choice(["the", "of", "Reading", "xyzzy,", "été", "42"]) for _ in range(r.randint(0, 80)))) for d in range(300)]
    data += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5000, None), (5001, "long " * 50_000), (None, "last one")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5).withColumns({"id": F.lit("i"), "part": F.lit(1), "ids": F.lit(2)})
    out = {x.doc_id: x for x in token_table(docs, PATH, shard_ids=3000).collect()}
    whole, at = Tokenizer.from_file(PATH), 0
    for d, t in sorted(data, key=lambda x: (x[0] is None, x[0])):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert (out[d].start, out[d].n_tokens, out[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(out) == len(data)
    assert token_table(docs.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(x.start for x in token_table(twice, PATH).collect()) == [0, 2, 4]
