"""Work and memory of the queries that grew faster than their tables; the results stay those of the plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import compare as C


@pytest.fixture(scope="module")
def series(spark):
    """Random series, copies of some, flat ones and ones of one point; one row has no key."""
    rng = np.random.default_rng(7)
    data = {k: rng.normal(size=int(n)).round(2) for k, n in enumerate(rng.integers(2, 30, 60))}
    data |= {100 + k: data[k] for k in range(0, 60, 3)} | {200: np.ones(5), 201: np.ones(1)}
    rows = [(k, i, float(x)) for k, v in data.items() for i, x in enumerate(v)]
    return spark.createDataFrame([*rows, (None, 0, 1.0), (None, 1, 2.0)], "series_id long, idx int, value double").cache()


@pytest.mark.parametrize("block,piece", [(256, 1 << 19), (5, 1 << 19), (3, 20)])
def test_strips_meet_every_pair_once(series, monkeypatch, block, piece):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "PIECE", piece)
    keyed = series.where("series_id IS NOT NULL")
    upper = C.similarity(series).cache()
    pairs = [(r.series_i, r.series_j) for r in upper.collect()]
    ids = sorted(r.series_id for r in keyed.select("series_id").distinct().collect())
    assert sorted(pairs) == [(i, j) for i in ids for j in ids if i < j]
    want = {(r.series_i, r.series_j): round(r.similarity, 9) for r in C.matrix(upper, keyed).collect()}
    got = C.full_matrix(keyed).collect()
    assert len(got) == len(ids) ** 2 and {(r.series_i, r.series_j): round(r.similarity, 9) for r in got} == want


def test_outlier_and_closest_pair_need_no_table_of_pairs(series, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 5)
    monkeypatch.setattr(C, "PIECE", 50)
    keyed = series.where("series_id IS NOT NULL")
    for some in (keyed, keyed.where("series_id < 60"), keyed.where("series_id >= 200 OR series_id = 1"), keyed.where("series_id < 2"), keyed.where("series_id < 0")):
        upper = C.similarity(some).cache()
        for got, want in ((C.outlier(some), C.most_unique(upper)), (C.closest_pair(some), C.most_similar(upper))):
            got, want = got.collect(), want.collect()
            assert [r[:-1] for r in map(tuple, got)] == [r[:-1] for r in map(tuple, want)]
            assert [r[-1] for r in got] == pytest.approx([r[-1] for r in want])
    assert tuple(C.closest_pair(keyed).first())[:2] == (0, 100)


def test_keys_of_text_are_compared(series):
    named = series.where("series_id IS NOT NULL").withColumn("series_id", F.concat(F.lit("s"), F.col("series_id").cast("string")))
    assert all(r.series_i < r.series_j for r in C.similarity(named).collect())
    assert C.closest_pair(named).first()[:2] == ("s0", "s100")


def test_a_series_is_sent_to_a_bounded_number_of_strips():
    assert [C._parts(n) for n in (0, 1, 256, 257, 1500, 9_000, 90_000, 500_000)] == [1, 1, 1, 3, 7, 31, 31, 31]
    assert all(C._parts(n) % 2 and n / C._parts(n) <= C.LARGEST for n in (540_000, 5_400_000))


PLAIN = ["lexical_richness", "simpson", "honore", "top_keywords", "token_counts", "brush_blocks", "book_metadata", "fingerprint_nested", "fingerprint_blocks"]


@pytest.mark.parametrize("name", PLAIN)
def test_blocks_are_measured_where_their_text_lies(spark, name):
    """No exchange, no join; each text is tokenised once for each kind of token."""
    from quillspark.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == (2 if name.startswith("fingerprint") else 1)


@pytest.mark.parametrize("name", ["keyword_vocabulary", "global_range", "global_range_all", "book_overview", "sorted_books", "colour_position", "brush_top3", "positional_join"])
def test_rows_a_token_are_not_shuffled(spark, name):
    """What is left of exchanges gets a row a block at most."""
    from quillspark.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and (name == "keyword_vocabulary" or "tok#" not in "".join(x for x in plan.splitlines() if "Exchange" in x))


@pytest.mark.parametrize("run", [1, 100, 1 << 19])
@pytest.mark.parametrize("size,overlap", [(20, 15), (20, 13), (7, 0)])
def test_counts_by_runs_equal_plain_counts(spark, monkeypatch, run, size, overlap):
    from collections import Counter

    from quillspark.functions.words import STOPWORDS
    from quillspark.operators import blocks as B
    from quillspark.operators import lexical as L

    monkeypatch.setattr(B.Counts, "RUN", run)
    rng = np.random.default_rng(5)
    texts = [None, "", "too short", *(" ".join(rng.choice(["the", "river", "a-b", "12", "...", "Blood", "é", "and"], n)) for n in (19, 20, 90, 300, 41))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    step, want, top = size - overlap, {}, {}
    for d, text in enumerate(texts):
        words = (text or "").split()
        for b in range((len(words) - size) // step + 1 if len(words) >= size else 0):
            toks = ["" .join(t) for w in words[b * step : b * step + size] for t in w.lower().split("-") if t.isalpha()]
            want[d, b] = Counter(toks)
            first = {t: toks.index(t) for t in toks}
            top[d, b] = sorted((t for t in first if t not in STOPWORDS), key=lambda t: (-want[d, b][t], first[t]))[:2]
    got: dict = {k: Counter() for k in want}
    for r in B.token_panes(df, size, overlap).collect():
        got[r.doc_id, r.block][r.tok] = r.n
    assert got == want
    rich = {(r.doc_id, r.block): (r.n_tokens, r.n_types, r.n_hapax) for r in L.lexical_richness(df, size, overlap).collect()}
    assert rich == {k: (sum(c.values()), len(c), sum(n == 1 for n in c.values())) for k, c in want.items()}
    ranked: dict = {k: [] for k in want}
    for r in L.keyword_rows(df, size, overlap, n=2).orderBy("doc_id", "block", "rank").collect():
        ranked[r.doc_id, r.block].append(r.tok)
        assert r.n == want[r.doc_id, r.block][r.tok]
    assert ranked == top


def test_a_mean_at_a_half_goes_up_in_any_order(spark):
    """0.0062 and 0.0063 both came from sums of these, by their order; the exact mean is 0.00625."""
    from quillspark.operators import corpus as K

    pairs = [268, 220, 268, 326, 252, 194, 214, 248]
    for some in (pairs, pairs[::-1], sorted(pairs)):
        df = spark.createDataFrame([([p / 39800 for p in some],)], "v array<double>")
        assert df.select(K._mean(F.col("v"), 4).alias("m")).first().m == 0.0063


def test_fingerprints_have_each_block_once(spark, tmp_path):
    """Many documents in many files, which joins of shared exchanges gave twice."""
    from quillspark.operators import corpus as K

    text = " ".join(f"river{'s' * (i % 5)} the blood." if i % 3 else "and he did" for i in range(30))
    spark.range(300).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).repartition(7).write.parquet(str(tmp_path / "d"))
    rows = K.fingerprints(spark.read.parquet(str(tmp_path / "d")), 20, 10).collect()
    blocks = (len(text.split()) - 20) // 10 + 1
    assert len(rows) == 300 and all([b.block for b in r.functionWords] == list(range(blocks)) == [b.block for b in r.simpsonIndex] and r.metadata.totalBlocks == blocks for r in rows)


def test_a_mean_at_a_limit_is_not_below_it(spark):
    """49.97 + 50.03 + ... is 50 or a little less, by the order of the sum."""
    from quillspark.operators import series as X

    df = spark.createDataFrame([(50.0, 0.3), (49.99999999999999, 0.30000000000000004), (49.99, 0.31)], "mean double, cv double")
    got = [r.s for r in df.select(X.style(F.lit("Hapax"), F.col("mean"), F.col("cv")).alias("s")).collect()]
    assert got[0] == got[1] != got[2]


@pytest.mark.parametrize("centres,cells", [(16_384, 1 << 19), (3, 40)])
def test_cluster_keywords_equal_plain_counts(spark, monkeypatch, centres, cells):
    """Shares of a cell, a crowd on one place, points without words, words that stand twice; no pair is shuffled."""
    from quillspark.operators import neighbours as N

    monkeypatch.setattr(N, "CENTRES", centres)
    monkeypatch.setattr(N, "CELLS", cells)
    rng = np.random.default_rng(2)
    at = {int(k): tuple(map(float, xy)) for k, xy in zip(rng.permutation(80), rng.uniform(-1, 1, (80, 2)))} | {100 + k: (0.3, 0.3) for k in range(20)} | {200: (9.0, 9.0)}
    words = [(k, p, str(w)) for k in at if k % 7 for p, w in enumerate(rng.choice(["a", "b", "c", "d", "é"], 4))]
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in at.items()] + [(300, None, 1.0)], "id long, x double, y double")
    df = N.cluster_keywords(points, spark.createDataFrame(words, "id long, pos int, word string"), 0.5, n=3)
    want = set()
    for k, (x, y) in at.items():
        seen = [w for w in sorted(words) if np.sqrt((at[w[0]][0] - x) ** 2 + (at[w[0]][1] - y) ** 2) < 0.5]
        count, first = {}, {}
        for i, (_, _, w) in enumerate(seen):
            count[w] = count.get(w, 0) + 1
            first.setdefault(w, i)
        want |= {(k, r, w, count[w]) for r, w in enumerate(sorted(count, key=lambda w: (-count[w], first[w]))[:3], 1)}
    assert set(map(tuple, df.collect())) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2 and "neighbour" not in plan
