import re

import pytest

from quillspark.functions.words import CONTRACTIONS
from quillspark.plans.queries import ORACLES, QUERIES

TEXTS = [None, "", "Don't stop; it\u2019s CAN'T, xdon't", "word, " * 20000 + "we've é isn't", "a" * 18, "a" * 19, "Ab-1 " * 30 + "é\n_Z"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return str(d)


def brute(text):
    return text and re.sub(r"(?<!\w)(?:" + "|".join(CONTRACTIONS) + r")(?!\w)", lambda m: CONTRACTIONS[m.group().lower()], text, flags=re.I)


def test_contractions_of_whole_texts_are_expanded(spark, sf_dir):
    got = {r.doc_id: r.expanded for r in QUERIES["contractions_whole"](spark, sf_dir).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert got[3].endswith("we have é is not")


def test_names_of_whole_texts(spark, sf_dir):
    got = {r.doc_id: (r.title, r.safe, r.bare) for r in QUERIES["names_whole"](spark, sf_dir).collect()}
    strip = lambda t, fill: t and re.sub("[^a-zA-Z0-9]", fill, t)
    assert got == {i: (t[:15] + "..." if len(t or "") > 18 else t, strip(t, "_"), strip(t, "")) for i, t in enumerate(TEXTS)}


def test_names_agree_with_their_sql_on_sf0001(spark):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted(db.execute(ORACLES["names_whole"]).fetchall()) == sorted(map(tuple, QUERIES["names_whole"](spark, d).collect()))


def test_fingerprints_of_null_empty_short_and_wordless_texts(spark):
    from quillspark.operators import corpus as K

    rows = [(None, "river " * 40), (1, None), (2, ""), (3, "too short"), (4, "1 2 ... " * 20), (5, "River blood. The river! " * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in K.fingerprints(docs, 20, 10).collect()}
    assert set(got) == {4, 5}
    assert [(b.value, b.keywords) for b in got[4].simpsonIndex] == [(0.0, [])] * 5 and got[4].metadata.avgSentenceLength == 0
    assert got[5].simpsonIndex[0].keywords == ["river", "blood"] and got[5].sentenceLength[0].value == 2.0
    assert {r.doc_id: (r.total_blocks, r.total_words) for r in K.metadata(docs, 20, 10).collect()} == {4: (5, 100), 5: (3, 60)}
    assert K.fingerprints(docs.limit(0), 20, 10).collect() == K.metadata(docs.limit(0), 20, 10).collect() == []


def test_panes_agree_with_single_blocks(spark):
    from collections import Counter

    from quillspark.operators import blocks as B

    words = [f"w{'abc'[i % 3]}-{'xy'[i % 2]}" if i % 7 else "..." for i in range(95)]
    docs = spark.createDataFrame([(1, "  ".join(words))], "doc_id long, text string")
    for size, overlap in ((20, 10), (20, 13), (20, 0), (95, 94), (96, 0)):
        got: dict[int, Counter] = {}
        for r in B.token_panes(docs, size, overlap).collect():
            got.setdefault(r.block, Counter())[r.tok] = r.n
        step = size - overlap
        want = {b: Counter(re.findall("[a-z]+", " ".join(words[b * step : b * step + size]))) for b in range((95 - size) // step + 1)}
        assert got == want


def test_global_range_of_all_metrics_equals_its_series(spark):
    from quillspark.operators import corpus as K

    d = "/root/testdata/sf0.001"
    got = {r.metric: (r.lo, r.hi) for r in QUERIES["global_range_all"](spark, d).collect()}
    plane = [r.pc1 for r in QUERIES["pca_coordinates"](spark, d).collect()]
    assert set(got) == set(K.METRICS)
    assert got["functionWords"] == pytest.approx((min(plane), max(plane)), abs=1e-6)
    blocks = [b for r in QUERIES["fingerprint_nested"](spark, d).collect() for b in r.sentenceLength]
    assert got["sentenceLength"] == pytest.approx((min(b.value for b in blocks), max(b.value for b in blocks)), abs=1e-4)
