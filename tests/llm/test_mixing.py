import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.mixing import DOMAINS, SHARES, apply_mix, described, fit_rates, mix, op8_soft_mixing

SCHEMA = "doc_id long, text string, tokens string, rate int"


def corpus(n=400):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.4
        w = [rnd.choice(["the", "that", "with", "and"]) for _ in range(rnd.randint(3, 200))]
        rows.append((i, " ".join(x + "&!" if bad else x for x in w), "c", 3))
        if i % 2:
            labels.append((i, int(not bad), 0))
    return rows, labels


def frames(spark, n=400):
    rows, labels = corpus(n)
    odd = [(None, "the", "c", 3), (9001, None, "c", 3), (9002, "", "c", 3), (9002, "", "c", 3), (9003, "the " * 30000, "c", 3)]
    return spark.createDataFrame(rows + odd, SCHEMA), spark.createDataFrame([*labels, (None, 1, 0), (3, None, None), (77777, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")


def test_targets_are_met_and_posteriors_fit(spark):
    docs, labels = frames(spark)
    out = mix(docs, labels).collect()
    assert len(out) == 404
    t, p, r = (np.array([getattr(x, k) for x in out], float) for k in ("tokens", "p", "rate"))
    assert np.allclose(p.sum(1), 1) and (r >= 0).all()
    base, got = (t[:, None] * p).sum(0), ((r * t)[:, None] * p).sum(0)
    assert np.allclose(got, base.sum() * np.array([SHARES[n] for n, _ in DOMAINS]), rtol=1e-5)
    truth = {i: "&" in x for i, x, *_ in corpus()[0]}
    assert np.mean([(x.p[1] > 0.5) == truth[x.doc_id] for x in out if x.doc_id in truth and x.tokens > 20]) > 0.97
    assert {x.doc_id: x.tokens for x in out}[9003] >= 30000
    assert all(x.copies in (int(x.rate), int(x.rate) + 1) for x in out)


def test_projection_keeps_rates_nonnegative(spark):
    rows = [(i, 100, [0.9, 0.1] if i % 2 else [0.2, 0.8]) for i in range(50)]
    facts = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    out = fit_rates(facts, targets=[200.0, 1500.0]).collect()
    rate = np.array([x.rate for x in out])
    p = np.array([x.p for x in out])
    assert (rate >= 0).all() and rate.min() == 0
    # Against a plain projected gradient over all rates: the same least squares objective.
    r = np.ones(50)
    for _ in range(20000):
        gap = (r * 100) @ p - [200.0, 1500.0]
        r = np.maximum(r - 1e-7 * 100 * (p @ gap), 0)
    loss = lambda r: (((r * 100) @ p - [200.0, 1500.0]) ** 2).sum()
    assert loss(rate) <= loss(r) * 1.01 + 1


def test_copies_and_edges(spark):
    docs, labels = frames(spark, 60)
    out = apply_mix(docs, labels, floor=1.0)
    assert out.columns == docs.columns
    want = {(r.doc_id, r.tokens): r.copies for r in mix(docs, labels, floor=1.0).collect()}
    assert min(want.values()) >= 1  # nothing is left out
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert apply_mix(docs.limit(0), labels).collect() == []
    assert mix(docs, labels.limit(0)).where(F.abs(F.element_at("p", 1) - 0.5) > 1e-9).count() == 0
    assert described(docs, labels).where("tokens < 0").count() == 0


def test_targets_that_need_the_projection_are_met(spark):
    # Posteriors of all kinds: the low total can only fall this far with many rates at the bound.
    rnd = np.random.default_rng(5)
    low = rnd.beta(0.5, 2.0, 300)
    rows = [(i, int(t), [1 - float(q), float(q)]) for i, (t, q) in enumerate(zip(rnd.integers(1, 900, 300), low))]
    facts = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    t, p = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    base = t @ p
    told = {}
    got = fit_rates(facts, targets=list(base * [1.0, 0.2]), told=told).orderBy("doc_id").collect()
    assert told["steps"] > 1
    r = np.array([x.rate for x in got])
    assert (r >= 0).all() and (r == 0).sum() > 30
    assert np.allclose((r * t) @ p, base * [1.0, 0.2], rtol=1e-5)
    # Nearest to 1: off the bound 1 - rate is a combination of the posteriors, at it no more than that.
    y = np.linalg.lstsq(p[r > 0], 1 - r[r > 0], rcond=None)[0]
    assert np.allclose(r, np.maximum(1 - p @ y, 0), atol=1e-5)


def test_targets_out_of_reach_are_told(spark):
    facts = spark.createDataFrame([(i, 100, [0.9, 0.1] if i % 2 else [0.2, 0.8]) for i in range(50)], "doc_id long, tokens long, p array<double>")
    with pytest.warns(UserWarning, match="out of reach.*good 364.7.* of 200"):
        fit_rates(facts, targets=[200.0, 1500.0])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        fit_rates(facts, targets=[600.0, 1500.0])


def test_registered_targets_reach_the_bound(spark, tmp_path):
    rnd = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        share = rnd.choice([0.0, 0.1, 0.2, 0.4, 0.6, 0.9, 1.0])
        words = (rnd.choice(["the", "that", "with", "and"]) + ("&!" if rnd.random() < share else "") for _ in range(rnd.randint(30, 200)))
        docs.append((i, " ".join(words), "c", 3))
        labels.append((i, int(rnd.random() > share), 0))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = op8_soft_mixing(spark, str(tmp_path)).collect()
    assert min(x.rate for x in out) >= 0 and 0 in {x.copies for x in out}
    # The query's own rows against plain projected gradient least squares over all rates.
    t, r = np.array([x.tokens for x in out], float), np.array([x.rate for x in out])
    p = np.array([[x.p_good, x.p_low] for x in out])
    target = (t @ p).sum() * np.array([SHARES["good"], SHARES["low"]])
    assert (r == 0).any()
    a, plain = t[:, None] * p, np.ones(len(out))
    step = 1 / np.linalg.eigvalsh(a.T @ a).max()
    for _ in range(3000):
        plain = np.maximum(plain - step * (a @ (a.T @ plain - target)), 0)
    loss = lambda x: ((a.T @ x - target) ** 2).sum()
    assert loss(r) <= loss(plain) + 1e-9 * (target**2).sum()


def test_held_out_posteriors_and_clashing_columns(spark):
    docs, labels = frames(spark)
    p = {r.doc_id: r.p[1] for r in mix(docs, labels.where("doc_id % 4 = 1")).collect() if r.tokens > 20}
    truth = {i: "&" in x for i, x, *_ in corpus()[0]}
    held = [i for i in p if i is not None and i < 400 and i % 4 != 1]
    assert len(held) > 200 and np.mean([(p[i] > 0.5) == truth[i] for i in held]) > 0.95
    named = docs.selectExpr("*", "'k' AS _key0", "'n' AS _n", "'d' AS _d", "'c' AS _copies0", "'r' AS _r0")
    got = apply_mix(named, labels)
    assert got.columns == named.columns and {(r._key0, r._n, r._d, r._copies0, r._r0) for r in got.collect()} == {("k", "n", "d", "c", "r")}
