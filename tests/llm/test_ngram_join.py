import random
import re

import numpy as np

import pyarrow as pa
import pytest

from quillspark.llm import ngram_join
from quillspark.llm.kernel import shingle_sets
from quillspark.llm.ngram_join import Tree, _classes, _signatures, jaccard_components, keep_one, single_leaves

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string"


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeABé") for _ in range(3))
    texts = ["", None, "one", "One", "a b c d", "A  b\tc d", "a b c d e", " \n "]
    for _ in range(n):
        base = [word() for _ in range(rnd.choice([5, 9, 20, 60, 61, 250, 700]))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 4])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 8])):
                w[rnd.randrange(len(w))] = word()
            texts.append("\n".join(w) if rnd.random() < 0.3 else " ".join(w) + rnd.choice(["", " " + word()]))
    rnd.shuffle(texts)
    return list(enumerate(texts, 10))


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "x", "y", 1, "clash") for i, t in rows], SCHEMA)
        got = sorted(tuple(r) for r in jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect())
        assert got == brute(rows)


def test_near_copies_of_one_text_become_one_component(spark):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rnd.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(i, t, "x", "y", 1, "clash") for i, t in rows], SCHEMA)
    assert {r.component_id for r in jaccard_components(df).collect()} == {0}
    kept = keep_one(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [0]


def test_edges(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f", "", "", 1, ""), (1, "a b c d e f", "", "", 1, ""), (1, "q r s t u", "", "", 1, ""), (None, "z", "", "", 1, "")]
    got = sorted(str(tuple(r)) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(str(x) for x in [(1, 2, 1), (1, 1, 1), (None, 1, None)])


def test_linked_sets_share_a_block():
    rng = np.random.default_rng(0)
    for n in [*range(1, 40), 63, 64, 65, 255, 256, 300, 1023, 1024, 3000]:
        for _ in range(6):
            p = rng.integers(0, 2**63, n).astype(np.uint64)
            drop, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 5 + 1)
            q = np.unique(np.concatenate((p[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
            if 9 * len(np.intersect1d(p, q)) >= 4 * (len(p) + len(q)):
                blocks = [{(c, k) for c, g in _classes(len(s)) for k in _signatures(np.sort(s), c, g)[0].tolist()} for s in (p, q)]
                assert blocks[0] & blocks[1]


def near(points, n, i, j):
    a, b = points[i].astype(int), points[j].astype(int)
    bound = np.minimum(a, b).sum() + min(n[i] - a.sum(), n[j] - b.sum())
    return 9 * bound >= 4 * (n[i] + n[j]) and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j])


def clustered(seed=1, groups=8, each=60, width=30):
    rng = np.random.default_rng(seed)
    centres = rng.poisson(3, (groups, width)) * rng.integers(0, 3, (groups, width))
    points = (np.repeat(centres, each, 0) + rng.poisson(0.1, (groups * each, width))).astype(np.uint8)
    return points, points.sum(1, dtype=np.int64) + rng.integers(0, 3, len(points))


def test_tree_join_loses_nothing_and_prunes():
    points, n = clustered()
    comp, none = np.arange(len(n)), np.zeros(len(n), np.int64)
    tree = Tree(points, n, comp, none)
    got = {tuple(sorted(x)) for x in zip(*(a.tolist() for a in tree.join()))}
    want = {(j, i) for i in range(len(n)) for j in range(i) if near(points, n, i, j)}
    assert got == want and len(tree.join()[0]) == len(got)
    assert (tree.left >= 0).sum() > 3  # inner boxes
    leaves = int((tree.left < 0).sum())
    assert len(tree.leaf_pairs()[0]) < leaves * (leaves + 1) // 2
    spanned = {tuple(sorted(x)) for x in zip(*(a.tolist() for a in tree.span()))}
    assert spanned <= got and len(tree.span()[0]) <= 2 * len(n)
    half = np.arange(len(n)) % 2
    sided = {tuple(sorted(x)) for x in zip(*(a.tolist() for a in Tree(points, n, comp, half).join()))}
    assert sided == {(j, i) for j, i in want if (i + j) % 2}
    apart = {tuple(sorted(x)) for x in zip(*(a.tolist() for a in Tree(points, n, comp // 60, none).join()))}
    assert apart == {(j, i) for j, i in want if i // 60 != j // 60}


def test_single_leaves_equal_trees():
    points, n = clustered(2, 10, 20)
    block = np.repeat(np.arange(10), 20)
    node = np.arange(200) * 7 % 211
    comp = node.copy()
    a, b = single_leaves(block, points, n, comp, node)
    want = {(j, i) for i in range(200) for j in range(i) if i // 20 == j // 20 and near(points, n, i, j)}
    assert {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist())} == want


@pytest.mark.parametrize("block, leaf, share", [(4, 2, 1), (7, 3, 2), (64, 8, 1)])
def test_small_trees_and_parts_equal_brute_force(spark, monkeypatch, block, leaf, share):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "SHARE_OF_BLOCKS", share)
    monkeypatch.setattr(ngram_join, "PARTNERS", 2)
    rows = corpus(3, 50)
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    for i in range(40):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(99)}"
        rows.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame([(i, t, "x", "y", 1, "clash") for i, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def test_links_come_through_the_tree(spark, monkeypatch):
    """Without what the trees' joins give there is no link at all between different texts."""
    rows = [(i, " ".join(f"w{k}" for k in range(60)) + f" x{i}") for i in range(5)]
    df = spark.createDataFrame([(i, t, "x", "y", 1, "clash") for i, t in rows], SCHEMA)
    assert {r.component_id for r in jaccard_components(df).collect()} == {0}
    monkeypatch.setattr(ngram_join, "_block_pairs", lambda spanning: lambda batches: (pa.RecordBatch.from_pylist([], pa.schema([("a", pa.int64()), ("b", pa.int64())])) for _ in batches))
    assert len({r.component_id for r in jaccard_components(df).collect()}) == 5


def test_very_long_and_repeated_texts(spark):
    rnd = random.Random(4)
    long = [rnd.choice("abcdefgh") + rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(20000)]
    other = [w if rnd.random() > 0.01 else "zz" for w in long]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, "p q r s t u v"), (3, "p q r s t u v"), (9, " ".join(long))]
    df = spark.createDataFrame([(i, t, "x", "y", 1, "clash") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    sets = shingle_sets(pa.array([t for _, t in rows]))
    assert got == {1: (len(sets[0]), 1), 2: (len(sets[1]), 1), 3: (3, 3), 9: (len(sets[4]), 1)}


def test_keep_one_takes_any_column_names(spark):
    rows = [(2, "a b c d e f", "p", "q"), (1, "a b c d e f", "r", "s"), (1, "a b c d e f", "r2", "s"), (None, "z", "t", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key0 string, _d string")
    df = df.withColumnsRenamed({"_d": "_d0"}).withColumn("_row", df["_key0"]).withColumn("_r0", df["_key0"]).withColumn("node", df["_key0"])
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "None"] and all(r._key0 == r.node == r._row for r in got.collect())
