import hashlib
import random

import numpy as np

import pytest

from quillspark.llm import substring_dedup
from quillspark.llm.substring_dedup import LENGTH, brute_force, match_lengths, remove_repeats, repeated_windows, stretches, suffix_array, window_minimum

SCHEMA = "doc_id long, text string, anchor int, _row string"


def corpus(seed, n=60):
    rnd = random.Random(seed)
    noise = lambda k: "".join(rnd.choice("ab cdeé\n") for _ in range(k))
    pool = [noise(rnd.choice([350, 399, 400, 401, 450, 700, 1500])) for _ in range(12)]
    texts = [None, "", "x" * 399, "y" * 400, "z" * 401, "ab" * 900, "q" * 30 + "ab" * 400]
    for _ in range(n):
        t = noise(rnd.choice([0, 50, 300, 900]))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(pool)
            cut = rnd.randint(0, 60) if rnd.random() < 0.5 else 0
            t += p[cut:] + noise(rnd.choice([0, 1, 40, 500]))
        texts.append(t)
    texts += texts[10:14]
    return texts


def answers(spark, texts, ids=None):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(df).collect())


def test_equals_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        assert answers(spark, texts) == [(i, *x) for i, x in enumerate(brute_force(texts))]


@pytest.mark.parametrize("part, intervals", [(1, (25, 6, 1)), (2, (25, 6, 1)), (3, (40, 1))])
def test_split_groups_equal_brute_force(spark, monkeypatch, part, intervals):
    monkeypatch.setattr(substring_dedup, "PART", part)
    monkeypatch.setattr(substring_dedup, "INTERVALS", intervals)
    texts = corpus(7, 40)
    assert answers(spark, texts) == [(i, *x) for i, x in enumerate(brute_force(texts))]


def test_a_frequent_string_under_the_length_stays(spark):
    rnd = random.Random(11)
    noise = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    shared, long = noise(380), noise(430)
    texts = [noise(150) + shared + noise(150) for _ in range(2300)] + [noise(40) + long + noise(40) for _ in range(3)]
    got = answers(spark, texts)
    assert [x[2] for x in got[:2300]] == [0] * 2300
    assert [x[2] for x in got[2300:]] == [430] * 3


def test_stretches_hold_each_window_once():
    context, lead = bytes(range(97, 97 + 20)) * 23, 70
    for width in (101, 25, 6, 1):
        found = [k for _, x, y, cut in stretches(context, lead, width) for k in range(x, y + 1) if len(cut) == y - x + LENGTH]
        assert sorted(found) == list(range(len(context) - LENGTH + 1))


def test_index_finds_all_repeated_windows():
    rnd = random.Random(3)
    noise = lambda k: bytes(rnd.choice(b"abcd") for _ in range(k))
    core = noise(420)
    contexts = [noise(a) + core[c:] + noise(b) for a, b, c in ((0, 0, 0), (7, 9, 0), (80, 0, 5), (3, 80, 30), (0, 3, 0))] + [noise(450), b"a" * 500]
    contexts += [contexts[1][:-4] + b"zzzz", contexts[1][:-4] + b"yzzz"]
    seen = {}
    for c in contexts:
        for s in range(len(c) - LENGTH + 1):
            seen[c[s : s + LENGTH]] = seen.get(c[s : s + LENGTH], 0) + 1
    for c, found in zip(contexts, repeated_windows(contexts)):
        assert found.tolist() == [seen[c[s : s + LENGTH]] > 1 for s in range(len(c) - LENGTH + 1)]


def test_suffix_array_and_match_lengths():
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(97, 99, 300), 256)
    text[100] = text[200] = 256
    stops = np.flatnonzero(text == 256)
    room = stops[np.searchsorted(stops, np.arange(301))] - np.arange(301)
    tail = lambda i: (text[i : i + room[i]].tolist() + [256], i)
    assert suffix_array(text, room, 400).tolist() == sorted(range(301), key=tail)

    def lcp(a, b):
        k = 0
        while k < min(room[a], room[b]) and text[a + k] == text[b + k]:
            k += 1
        return k

    got = match_lengths(text, 6, 400)
    for i in range(301):
        want = max(lcp(i, j) for j in range(301) if j != i)
        assert got[i] == want if want >= 6 else got[i] < 6


def test_window_minimum():
    rng = np.random.default_rng(1)
    for n, w in ((5, 5), (17, 4), (400, 101), (103, 101)):
        x = rng.integers(0, 9, n).astype(np.uint64)
        assert window_minimum(x, w).tolist() == [i + int(np.argmin(x[i : i + w])) for i in range(n - w + 1)]


def test_edges(spark):
    assert answers(spark, []) == []
    long = "".join(random.Random(9).choice("abcdef ") for _ in range(30000))
    texts = [long, long, "k" + long[5000:5500] + "k", "k" * 10]
    assert answers(spark, texts, [1, 1, 2, None] and [1, 1, 2, 3]) == sorted((i, *x) for i, x in zip([1, 1, 2, 3], brute_force(texts)))
