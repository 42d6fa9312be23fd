import random

import pytest

from quillspark.llm.line_dedup import dedup_lines, op10_line_dedup

SCHEMA = "doc_id long, text string, _row string, cuts int, n_chars long"


def brute(rows, least=50):
    lines = {i: (t or "").split("\n") for i, t in rows}
    seen, gone = set(), {i: set() for i in lines}
    for i in sorted(lines):
        n = len(lines[i])
        for a in range(n):
            now = []
            for b in range(a, n):
                run = tuple(lines[i][a : b + 1])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone[i].update(range(a, b + 1))
                    now.append(run)
            seen.update(now)
    out = {}
    for i, t in rows:
        out[i] = (t if not gone[i] else "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]), len(gone[i]))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choice("abcdefgh") * 2 for _ in range(rnd.choice([0, 1, 3, 8, 8, 12, 30, 70])))
    pool = [[line() for _ in range(rnd.randint(1, 9))] for _ in range(12)]
    texts = [None, "", "\n\n", "a"]
    for _ in range(n):
        got = []
        for _ in range(rnd.randint(1, 5)):
            part = rnd.choice(pool) if rnd.random() < 0.6 else [line() for _ in range(rnd.randint(1, 6))]
            got += part[rnd.randint(0, 1) :] if rnd.random() < 0.3 else part
        texts.append("\n".join(got))
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    for seed in range(4):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "r", 5, 7) for i, t in rows], SCHEMA)
        out = dedup_lines(df.drop("_row"))
        assert out.columns == ["doc_id", "text", "cuts", "n_chars", "_removed"]
        got = {r.doc_id: (r.text, r._removed) for r in out.collect()}
        assert got == brute(rows), seed


def test_planted_passage_goes_from_the_later_document_only(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(5, "late start\n" + passage + "\nlate end"), (2, "early\n" + passage), (9, "short\nshort\nshort"), (7, None)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: "late start\nlate end", 2: "early\n" + passage, 9: "short\nshort\nshort", 7: None}


def test_edges(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = "\n".join(" ".join(f"{i}w{k}" for k in range(20)) for i in range(4000))
    rows = [(1, long), (1, long), (3, long)]
    got = sorted((r.doc_id, len(r.text), r._removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, len(long), 0), (1, len(long), 0), (3, 0, 4000)]


@pytest.mark.parametrize("least", [1, 2, 7, 8, 25])
def test_shorter_runs_equal_brute_force(spark, least):
    for seed in range(2):
        rows = corpus(seed)
        got = {r.doc_id: (r.text, r._removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
        assert got == brute(rows, least), seed
    with pytest.raises(ValueError):
        dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 0)


def test_query_takes_repeated_lines(spark, tmp_path):
    line = "this line of nine words is in all texts"
    spark.createDataFrame([(i, f"start {i}\n{line}\nend {i}") for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in op10_line_dedup(spark, str(tmp_path)).collect()) == [(0, 3, 0)] + [(i, 3, 1) for i in range(1, 5)]
