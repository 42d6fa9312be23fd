import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from quillspark.llm import mixing
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_near

BAD = ["idiot", "scum", "moron", "trash"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(11)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("aeiou") + rnd.choice("mnrstlk") + rnd.choice("aeiou")
    passage = " ".join(word() for _ in range(60))
    docs, labels = [], []
    for i in range(300):
        w = [word() for _ in range(rnd.choice([30, 60, 120]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        text = " ".join(w)
        if i % 10 == 3:
            text += "\n" + passage
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 3 > 0), int(toxic)))
    for i in range(300, 330):
        w = docs[i - 299][1].split(" ")
        if len(w) >= 100:
            w[rnd.randrange(len(w) - 5)] = "zz"
        docs.append((i, " ".join(w), "en", "s", 1))
    docs += [(400, "", "en", "s", 0), (401, None, "en", "s", None)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_equal_brute_force_on_their_own_inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns = docs.columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    clean = P.drop_toxic(spark, docs, sf_dir).cache()
    assert clean.columns == columns
    assert text(clean) == {i: t for i, t in text(docs).items() if not any(b in (t or "") for b in BAD)}
    lines = P.drop_repeated_lines(spark, clean, sf_dir).cache()
    want = brute_lines(sorted(text(clean).items()))
    assert lines.columns == columns and text(lines) == {i: t for i, (t, n) in want.items() if not n or t.strip()}
    assert all(r.n_chars == len(r.text) for r in lines.collect() if want[r.doc_id][1])
    one = P.keep_one_of_near_copies(spark, lines, sf_dir).cache()
    groups = brute_near(sorted(text(lines).items()))
    assert one.columns == columns and set(text(one)) == {i for i, _, root in groups if i == root}
    mixed = P.mix_sources(spark, one, sf_dir).cache()
    copies = Counter(r.doc_id for r in mixed.collect())
    want = {r.doc_id: r.copies for r in mixing.mix(one, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.copies}
    assert mixed.columns == columns and copies == want
    assert text(mixed) == {i: t for i, t in text(one).items() if i in want}
    out = P.encode_texts(spark, mixed, sf_dir)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in out.collect()) == sorted(
        (r.doc_id, len(ids(r.text)), hashlib.sha256(np.array(ids(r.text), "<u4").tobytes()).hexdigest()) for r in mixed.collect())


def test_stages_take_repeated_rows_empty_tables_and_any_column_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["score", "spans", "_text", "_text0", "_row", "_cuts", "_d", "_removed", "_removed0", "_key", "_n", "_copies", "rate", "node", "component", "p", "tokens"]
    odd = docs.unionByName(docs.where("doc_id < 40")).select("*", *[F.lit(n).alias(n) for n in names])
    for name, function in P.STAGES[:-1]:
        assert function(spark, odd.limit(0), sf_dir).collect() == [], name
        out = function(spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in names), name
    assert P.encode_texts(spark, odd, sf_dir).count() == odd.count()


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "soft_mixing", "bpe"]
