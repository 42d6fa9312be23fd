"""Hand-computed cases of the measures, cleaning and blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.words import STOPWORDS
from quillspark.operators import blocks as B
from quillspark.operators import compare as C
from quillspark.operators import corpus as K
from quillspark.operators import lexical as L
from quillspark.operators import series as X


def one(spark, text, size=None):
    n = size or max(1, len((text or "").split()))
    return spark.createDataFrame([(1, text)], "doc_id long, text string"), n


def value(spark, text, f):
    df, _ = one(spark, text)
    return df.select(f(F.col("text")).alias("v")).first().v


@pytest.mark.parametrize("text,want", [("This is a short sentence. This one is a bit longer indeed.", 6.0), ("", 0.0)])
def test_sentence_length(spark, text, want):
    assert value(spark, text, L.sentence_length) == pytest.approx(want)


@pytest.mark.parametrize("text,simpson,honore", [
    ("a b a b", 4 / 12, 100 * math.log(4)), ("lonely", 0.0, 0.0), ("a b c a b", 4 / 20, 100 * math.log(5) / (1 - 1 / 3)), ("a b c", 0.0, 0.0), ("12 34", 0.0, 0.0)])
def test_richness(spark, text, simpson, honore):
    df, n = one(spark, text)
    row = L.lexical_richness(df, n, 0).first()
    assert (row.simpson, row.honore) == (pytest.approx(simpson), pytest.approx(honore))


def test_empty_text_has_no_blocks(spark):
    df, _ = one(spark, "")
    assert L.lexical_richness(df, 1, 0).collect() == []


@pytest.mark.parametrize("text,n,want", [("river river river blood blood dark", 2, ["river", "blood"]), ("the and of river", 5, ["river"]), ("b a b a c", 3, ["b", "c"]), ("the and", 3, [])])
def test_keywords(spark, text, n, want):
    df, size = one(spark, text)
    got = L.top_keywords(B.token_panes(df, size, 0), ["doc_id", "block"], n).orderBy("rank").collect()
    assert [r.tok for r in got] == want


def test_blocks(spark):
    df, _ = one(spark, " ".join(f"w{i}" for i in range(25)))
    got = B.blocks(df, 10, 8).orderBy("block").collect()
    assert len(got) == 8 and len(got[0].words) == 10 and got[7].words[0] == "w14"
    assert B.blocks(one(spark, "too short")[0], 1000, 900).collect() == []
    for size, overlap in ((10, 10), (10, 12), (0, 0), (5, -1)):
        with pytest.raises(ValueError):
            B.blocks(df, size, overlap)


def test_panes_equal_block_by_block_counts(spark):
    df, _ = one(spark, "It's a-b c. D a b! x9y z " * 40)
    a = B.token_panes(df, 20, 15).select("block", "tok", "n")
    words = df.select(T.words(F.col("text")).alias("w")).first().w
    import re

    want = {}
    for k in range((len(words) - 20) // 5 + 1):
        for tok in re.findall(r"[^\W\d_]+", " ".join(words[5 * k : 5 * k + 20]).lower()):
            want[k, tok] = want.get((k, tok), 0) + 1
    assert {(r.block, r.tok): r.n for r in a.collect()} == want
    odd = B.token_panes(df, 20, 13).groupBy("block").agg(F.sum("n").alias("n"))
    assert odd.count() == (len(words) - 20) // 7 + 1


def test_gutenberg_trim(spark):
    marked = "Header\n*** START OF THE PROJECT GUTENBERG EBOOK SAMPLE ***\nThis is the real body text.\n*** END OF THE PROJECT GUTENBERG EBOOK SAMPLE ***\nlicence"
    assert value(spark, marked, T.clean) == "This is the real body text."
    assert value(spark, marked.replace("*** END", "END"), T.gutenberg_trim).startswith("Header")
    first, second = marked.split("This is the real body text.\n")
    assert value(spark, second + "\n" + first, T.gutenberg_trim) == ""


def test_contractions(spark):
    assert value(spark, "Don't DON'T can't don’t xdon't isn't. It's", T.expand_contractions) == "do not do not cannot don’t xdon't is not. it is"


def test_chapters_and_names(spark):
    body = "x" * 60
    assert value(spark, f"CHAPTER I {body} chapter 12 {body}y Chapter ONE short", T.chapters) == [body, f"{body}y Chapter ONE short"]
    assert value(spark, "/a/b.c/The Book.v2.TXT", T.file_stem) == "The Book.v2"
    assert value(spark, "abcdef", lambda c: T.preview(c, 3)) == "abc..." and value(spark, "abc", lambda c: T.preview(c, 3)) == "abc"


SERIES = {"zigzag": [1, 3, 2, 4, 3], "short": [1, 2], "one": [5], "spike": [0] * 10 + [100], "constant": [2, 2, 2, 2], "up": list(range(10)), "down": list(range(9, -1, -1))}


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(k, i, float(x)) for k, v in SERIES.items() for i, x in enumerate(v)], "series_id string, idx int, value double").cache()


def by_id(df):
    return {r.series_id: r for r in df.collect()}


def test_series(series):
    turn = by_id(X.turning(series))
    assert (turn["zigzag"].turning_points, turn["zigzag"].volatility) == (3, 1.5) and turn["one"].volatility == 0
    z, q = by_id(X.zscore_anomalies(series)), by_id(X.iqr_anomalies(series))
    assert z["spike"].anomalies == "10" == q["spike"].iqr_anomalies
    assert z["short"].anomaly_count == 0 and "short" not in q and z["constant"].anomaly_count == 0
    trend = by_id(X.trend_p(series))
    assert "one" not in trend and trend["up"].slope == pytest.approx(1) and trend["up"].p_value < 1e-9 and trend["short"].p_value == 1
    assert trend["zigzag"].p_value == pytest.approx(0.308, abs=2e-3) or trend["zigzag"].p_value > 0
    assert by_id(X.stats(series))["constant"].cv == 0


def test_student_p_values():
    for t, df, want in ((2.0, 10, 0.0733880), (1.0, 1, 0.5), (0.0, 5, 1.0), (12.706205, 1, 0.05), (2.570582, 5, 0.05), (1.959964, 1e7, 0.05)):
        assert X.student_p(t, df) == pytest.approx(want, abs=1e-6)


def test_comparison(series):
    upper = C.similarity(series).collect()
    sim = {(r.series_i, r.series_j): r.similarity for r in upper}
    assert sim["down", "up"] == pytest.approx(-1) and sim["constant", "up"] == 0 and sim["one", "up"] == 0
    assert len(sim) == 21
    full = C.matrix(C.similarity(series), series)
    assert full.count() == 49
    two = series.where("series_id IN ('up', 'down')")
    assert C.similarity(two).count() == 1 and C.most_unique(C.similarity(two)).collect() == []
    assert C.most_similar(C.similarity(two)).collect() == []
    best = C.most_similar(C.similarity(series)).first()
    assert best.similarity == max(r.similarity for r in upper)


def test_similarity_by_parts_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    rng = np.random.default_rng(3)
    data = {f"s{k}": rng.normal(size=int(n)) for k, n in enumerate(rng.integers(2, 40, 11))}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in data.items() for i, x in enumerate(v)], "series_id string, idx int, value double")
    at = {k: np.interp(np.linspace(0, len(v) - 1, C.POINTS), np.arange(len(v)), v) for k, v in data.items()}
    got = {(r.series_i, r.series_j): r.similarity for r in C.similarity(df).collect()}
    assert set(got) == {(i, j) for i in data for j in data if i < j}
    assert all(x == pytest.approx(np.corrcoef(at[i], at[j])[0, 1]) for (i, j), x in got.items())


def test_plane_and_vectors_equal_a_decomposition(spark):
    rnd = np.random.default_rng(1)
    words = ["the", "and", "of", "river", "to", "in", "blood", "it", "was"]
    text = " ".join(rnd.choice(words, 300))
    docs = spark.createDataFrame([(1, text), (2, "river blood " * 30), (3, "too short"), (4, None)], "doc_id long, text string")
    vectors = {(r.doc_id, r.block): r.vector for r in L.function_word_vectors(docs, 20, 10).collect()}
    vocabulary = list(dict.fromkeys(STOPWORDS))
    cut = text.split()
    for b in range(29):
        assert vectors[1, b] == [cut[10 * b : 10 * b + 20].count(w) if len(w) > 1 else 0 for w in vocabulary]
    m = np.array([vectors[1, b] for b in range(29)], float)
    m -= m.mean(0)
    u, d, _ = np.linalg.svd(m, full_matrices=False)
    got = {(r.doc_id, r.block): (r.pc1, r.pc2) for r in L.pca_coordinates(docs, 20, 10).collect()}
    assert set(got) == set(vectors) and all(got[2, b] == (0, 0) for b in range(5))
    mine = np.array([got[1, b] for b in range(29)])
    assert np.allclose(np.abs(mine), np.abs((u * d)[:, :2]))


def test_selections(spark):
    three = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "book string")
    names = lambda df: sorted(r.book for r in df.collect())
    assert names(K.toggle(three, "b")) == ["a", "c"] and names(K.toggle(three, "d")) == ["a", "b", "c", "d"]
    assert names(K.toggle(three.where("book = 'a'"), "a")) == ["a"] and names(K.toggle(three.limit(0), "a")) == ["a"]
    assert names(K.book_by_name(three, "b")) == ["b", "b"] and names(K.book_by_name(three, "x")) == [] and names(K.first_book(three)) == ["a"]
    assert names(K.selected_books(three, three.where("book <> 'a'"))) == ["b", "b", "c"]
    assert [r.book for r in K.sort_books(three.distinct().withColumn("n", F.length("book")), "n").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="no metrics"):
        K.block_metrics(three, metrics=("pages",))


def test_report(series):
    lines = K.report(series, "Sentence Length").orderBy("section", "series_id").collect()
    assert lines[0].line.startswith("📊") and sum(r.section == 1 for r in lines) == 7 and any(r.section == 4 for r in lines)
    assert [r.section for r in K.report(series.limit(0), "m").collect()] == [0]


def test_fingerprint_shape(spark):
    text = " ".join(f"river{'s' * (i % 5)} the blood." if i % 3 else "and he did" for i in range(30))
    row = K.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string"), 20, 10).first()
    assert [b.block for b in row.sentenceLength] == list(range(len(row.functionWords))) and row.metadata.totalWords == 20 * len(row.simpsonIndex)
    assert set(row.functionWords[0].asDict()) == {"block", "value", "value_y", "extended_preview", "keywords", "preview", "wordCount"}
