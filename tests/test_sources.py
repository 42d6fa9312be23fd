import json

import pytest

from quillspark.sources import files as S
from quillspark.streaming.uploads import follow


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_books_and_uploads(spark, tmp_path):
    write(tmp_path / "A b.txt", "Don't\n\nstop")
    write(tmp_path / "bad.txt", b"\xff\xfe")
    write(tmp_path / "no.md", "x")
    got = {r.book: r.text for r in S.read_books(spark, str(tmp_path)).collect()}
    assert got == {"A b": "do not stop", "bad": None}
    up = spark.createDataFrame([("X.TXT", bytearray(b"ok \xff!")), ("y.pdf", bytearray(b"no"))], "name string, content binary")
    assert [tuple(r) for r in S.read_uploads(up).collect()] == [("X", "ok !")]
    assert {r.book for r in S.book_names(S.read_books(spark, str(tmp_path)).limit(0)).collect()} >= {"The Call of the Wild"}


def test_corpus_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1.5]), ("b", 2, [])], "doc_id string, n int, v array<double>")
    S.write_corpus(df, str(tmp_path / "c"))
    back = S.read_corpus(spark, str(tmp_path / "c"), "struct<n int, v array<double>>").select("book", "fingerprint.*").collect()
    assert sorted((r.book, r.n, r.v) for r in back) == [("a", 1, [1.5]), ("b", 2, [])]
    S.write_books(df, str(tmp_path / "books"))
    assert spark.read.json(str(tmp_path / "books")).count() == 2
    assert S.newest(spark, str(tmp_path / "c"), "part-*").startswith("file:")


def test_stream_upserts(spark, tmp_path):
    inbox, corpus, check = (str(tmp_path / n) for n in ("in", "corpus", "check"))
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "one.txt", "first  text")
    follow(spark, inbox, corpus, check).awaitTermination()
    write(tmp_path / "in" / "two.txt", "second")
    follow(spark, inbox, corpus, check).awaitTermination()
    assert sorted((r.book, r.text) for r in spark.read.parquet(corpus).collect()) == [("one", "first text"), ("two", "second")]


def test_missing_paths_are_left_out_and_the_last_argument_wins(spark, tmp_path):
    for folder, text in (("z", "first"), ("a", "last")):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder / "one.txt", text)
    paths = [str(tmp_path / "z" / "one.txt"), str(tmp_path / "nowhere.txt"), str(tmp_path / "a" / "one.txt")]
    with pytest.warns(UserWarning, match="nowhere"):
        assert [tuple(r) for r in S.read_books(spark, *paths).collect()] == [("one", "last")]
    with pytest.warns(UserWarning):
        assert S.read_books(spark, paths[1]).collect() == []


def test_corpus_of_one_indented_object(spark, tmp_path):
    books = {"A": {"n": 1, "v": [1.5]}, "B": {"n": 2, "v": []}}
    for k, indent in enumerate((None, 2)):
        write(tmp_path / f"{k}.json", json.dumps(books, indent=indent))
        rows = S.read_corpus(spark, str(tmp_path / f"{k}.json"), "struct<n int, v array<double>>").select("book", "fingerprint.*").collect()
        assert sorted((r.book, r.n, r.v) for r in rows) == [("A", 1, [1.5]), ("B", 2, [])]
    write(tmp_path / "bad.json", "{not json")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        S.read_corpus(spark, str(tmp_path / "bad.json"), "struct<n int>").collect()


def test_corpus_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", 1)], "doc_id string, n int")

    for _ in range(2):
        assert [(r.book, r.n) for r in S.ensure_corpus(spark, str(tmp_path / "c"), "struct<n int>", build).select("book", "fingerprint.*").collect()] == [("a", 1)]
    assert built == [1]
