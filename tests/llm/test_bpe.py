import random

import numpy as np
import public_tokenizers
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.bpe import VOCABULARY, encode, tokenizer

PATH = public_tokenizers.path(VOCABULARY)
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
ODD = "abcdethinan 'st'LL0159.,!?-_\n\t\r\x0b\x1c\x1f\x85\xa0éÉñßΣςσİIıǅ́ 　漢字カナ😀🏽ﬁÅ½²Ⅷ<|>/w​﻿\u0000"


def agree(texts):
    own = tokenizer(PATH).encode_many(texts)
    for text, (ids, decoded), want in zip(texts, own, LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert decoded == LIBRARY.decode(want.ids, skip_special_tokens=False), text


def test_equals_the_library_on_random_text():
    rnd = random.Random(0)
    agree(["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 60))) for _ in range(3000)])
    words = ["".join(rnd.choice("thneingraodlsu") for _ in range(rnd.randint(1, 14))) for _ in range(20000)]
    agree([" ".join(words[i : i + 50]) for i in range(0, 20000, 50)])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library_on_any_text(text):
    agree([text])


def test_edges():
    agree([None, "", " ", "a<|startoftext|>B <|endoftext|><|endoftext|>x", "<|STARTOFTEXT|>", "x" * 3000, "ab" * 20000, "ΑΣ ΑΣΑ", "don't DON'T we'Ll"])


def test_cache_turns_over():
    bpe = tokenizer(PATH)
    size, bpe.CACHE = bpe.CACHE, 50
    try:
        rnd = random.Random(1)
        for _ in range(20):
            agree([" ".join("".join(rnd.choice("abcde") for _ in range(4)) for _ in range(60))])
    finally:
        bpe.CACHE = size


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello there", 5), (1, "Hello there", 5), (None, None, 5), (2, "", 5)], "doc_id long, text string, ids int")
    got = sorted((str(r.doc_id), r.n_tokens, bytes(r.ids).hex(), r.decoded) for r in encode(df, ["doc_id"]).collect())
    ids = LIBRARY.encode("Hello there", add_special_tokens=False).ids
    row = ("1", len(ids), b"".join(i.to_bytes(4, "little") for i in ids).hex(), LIBRARY.decode(ids))
    assert got == [row, row, ("2", 0, "", ""), ("None", 0, "", "")]
    assert encode(df.limit(0), ["doc_id"]).collect() == []
