import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import toxicity
from quillspark.llm.toxicity import apply, chains, fit, forward_backward, score, train

BAD = ["idiot", "scum", "moron"]


def corpus(n=600, seed=4):
    rnd = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        w = [rnd.choice("abcdefghijkl") + rnd.choice("aeiou") + rnd.choice("mnrst") for _ in range(rnd.choice([5, 30, 300]))]
        bad = rnd.random() < 0.3
        for _ in range(rnd.randint(1, 3) if bad else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(BAD))
        texts.append(" ".join(w) + ".")
        labels.append(int(bad != (rnd.random() < 0.02)))
    return texts, labels


@pytest.mark.parametrize("piece", [1, 2, 3, 128])
def test_forward_backward_equals_enumeration(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    rng = np.random.default_rng(0)
    unary, trans, init = rng.normal(size=9), rng.normal(size=(2, 2)), rng.normal(size=2)
    start, length = np.array([0, 4, 5]), np.array([4, 1, 4])
    p, z, pair, first = forward_backward(unary, start, length, trans, init)
    want, logz, pairs, firsts = np.zeros(9), 0.0, np.zeros((2, 2)), np.zeros(2)
    for s, n in zip(start, length):
        total = []
        for tags in itertools.product((0, 1), repeat=int(n)):
            total.append((tags, np.exp(init[tags[0]] + sum(unary[s + i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))))
        norm = sum(x for _, x in total)
        logz += np.log(norm)
        for tags, x in total:
            want[s : s + n] += np.array(tags) * x / norm
            firsts[tags[0]] += x / norm
            for a, b in zip(tags, tags[1:]):
                pairs[a, b] += x / norm
    assert np.allclose(p, want) and np.isclose(z, logz) and np.allclose(pair, pairs) and np.allclose(first, firsts)


def test_held_out_accuracy_and_offsets():
    texts, labels = corpus()
    model = train(texts[:400], labels[:400])
    s, found = apply(model, pa.array(texts[400:]))
    truth = [any(b in t for b in BAD) for t in texts[400:]]
    assert np.mean((s >= 0.7) == np.array(truth)) > 0.97
    words = {t.encode()[x["start"] : x["end"]].decode() for t, xs in zip(texts[400:], found) for x in xs}
    assert words == set(BAD)


def test_long_text_is_scored_whole():
    texts, labels = corpus()
    model = train(texts, labels)
    clean = "ban ton " * 20000
    (a, b), _ = apply(model, pa.array([clean, clean + "idiot " + clean[:8]]))
    assert b > a
    start, length = chains(np.array([0, 300, 300, 301]))
    assert start.tolist() == [0, 300] and length.tolist() == [300, 1]


def test_edges(spark):
    texts, labels = corpus(200)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(1000, None, "c"), (1001, "", "c"), (1001, "", "c"), (None, "x", "c")], "doc_id long, text string, score string")
    rows = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(5, None), (None, 1), (1001, 0)], "doc_id long, toxic int")
    out = score(docs, fit(docs, rows), ["doc_id"]).collect()
    assert len(out) == len(texts) + 4 and all(0 <= r.score <= 1 for r in out)
    assert score(docs.limit(0), fit(docs, rows), ["doc_id"]).collect() == []
    none = fit(docs, rows.where("toxic = 0"))  # one label only
    assert max(r.score for r in score(docs, none, ["doc_id"]).collect()) < 0.5
    fit(docs, rows.limit(0))
    assert zlib.crc32(b"1") % 3 in (0, 1, 2)


def test_scores_keep_clashing_columns(spark):
    texts, labels = corpus(200)
    model = train(texts, labels)
    docs = spark.createDataFrame([(1, "idiot moron", "a", "b", "c")], "doc_id long, text string, score string, _text0 string, spans string")
    row = score(docs, model, docs.columns, ("_s", "_p")).first()
    assert row[:5] == (1, "idiot moron", "a", "b", "c") and row._s > 0.7 and len(row._p) == 2


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    texts, labels = corpus(100)
    docs, rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    every, few = fit(docs, rows), None
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 9000)
    few = fit(docs, rows)
    assert 0 < len(few.words) < len(every.words)
    back = toxicity.unpacked(toxicity.packed(every))
    assert all(np.array_equal(getattr(back, f), getattr(every, f)) for f in toxicity.FIELDS)


def test_every_chain_is_trained_on(monkeypatch):
    texts, labels = corpus()[:2]
    seen = []

    def spy(unary, start, length, *rest):
        seen.append((len(start), int(length.sum())))
        return forward_backward(unary, start, length, *rest)

    monkeypatch.setattr(toxicity, "forward_backward", spy)
    train(texts, labels)
    assert len(set(seen)) == 1 and seen[0][0] >= sum(1 for t in texts if t)
