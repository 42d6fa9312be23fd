"""Sources and sinks: folders of text files, uploads, corpora as JSON."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

UPLOAD_LIMIT = 50 * 1024 * 1024


def _decoded(df: DataFrame, strict: bool) -> DataFrame:
    """``text`` of ``content``; strict: null where it isn't UTF-8, else bad bytes are dropped."""
    if strict:
        return df.withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    return df.withColumn("text", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_books(spark: SparkSession, *paths: str, clean: bool = True) -> DataFrame:
    """``(book, text)`` of the .txt files in folders or at paths; the book is the file's stem. Paths
    that don't exist are left out with a warning; of files with one stem the one of the last
    argument counts (within a folder the last path); null text where a file isn't UTF-8."""
    books = None
    for k, path in enumerate(paths):
        if not _exists(spark, path):
            warnings.warn(f"no file at {path}", stacklevel=2)
            continue
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("ignoreMissingFiles", "true").load(path).withColumn("argument", F.lit(k))
        books = files if books is None else books.unionByName(files)
    if books is None:
        return spark.createDataFrame([], "book string, text string")
    last = Window.partitionBy("book").orderBy(F.col("argument").desc(), F.col("path").desc())
    books = _decoded(books.withColumn("book", T.file_stem(F.col("path"))), True).withColumn("_r", F.row_number().over(last)).where("_r = 1")
    return books.select("book", (T.clean(F.col("text")) if clean else F.col("text")).alias("text"))


def read_uploads(uploads: DataFrame, clean: bool = False, keep_extension: bool = False) -> DataFrame:
    """``(book, text)`` of uploaded (name, content) rows: .txt names in any case, at most 50 MB, bad
    bytes dropped. ``clean`` is off, as raw uploads are analysed as they come."""
    fine = uploads.where(T.is_text_file(F.col("name")) & (F.octet_length("content") <= UPLOAD_LIMIT))
    text = _decoded(fine, False)
    return text.select((F.col("name") if keep_extension else T.file_stem(F.col("name"))).alias("book"), (T.clean(F.col("text")) if clean else F.col("text")).alias("text"))


def write_books(fingerprints: DataFrame, path: str, key: str = "doc_id") -> None:
    """A folder of JSON per book."""
    fingerprints.withColumn("_book", F.col(key)).write.mode("overwrite").partitionBy("_book").json(path)


def write_corpus(fingerprints: DataFrame, path: str, key: str = "doc_id") -> None:
    """The corpus as JSON lines, one object {book: fingerprint} each. (One object for all books is one
    value of unbounded size; readers here take both.)"""
    record = F.struct(*[c for c in fingerprints.columns if c != key])
    fingerprints.select(F.to_json(F.create_map(F.col(key).cast("string"), record)).alias("value")).write.mode("overwrite").text(path)


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(book, fingerprint)`` from JSON objects of book to fingerprint: one a line, or one that is the
    whole file, indented or not. A file is read whole only if its first line isn't an object by
    itself. Text that is neither raises an error when rows are read."""
    kind = f"map<string, {schema}>"
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    by_line = bool(first) and spark.range(1).select(F.try_parse_json(F.lit(first[0].value)).isNotNull()).first()[0]
    values = spark.read.text(path, wholetext=not by_line).where("trim(value) <> ''")
    parsed = F.from_json("value", kind, {"mode": "FAILFAST"})
    return values.select(F.explode(parsed).alias("book", "fingerprint"))


def ensure_corpus(spark: SparkSession, path: str, schema: str, build) -> DataFrame:
    """The corpus at ``path``, built by ``build()`` (fingerprints by doc_id) and written there first if it is
    missing: later calls read what is there."""
    if not _exists(spark, path):
        write_corpus(build(), path)
    return read_corpus(spark, path, schema)


def newest(spark: SparkSession, folder: str, pattern: str = "*.json") -> str | None:
    """The file of ``folder`` changed last: what to read where the corpus file is missing."""
    row = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path").limit(1).collect()
    return row[0].path if row else None


def book_names(books: DataFrame) -> DataFrame:
    """Names in order; three well-known ones where there are none."""
    found = books.select("book").distinct()
    if found.limit(1).count():
        return found.orderBy("book")
    names = ["The Adventures of Tom Sawyer", "The Adventures of Huckleberry Finn", "The Call of the Wild"]  # fixed values
    return books.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("book")).orderBy("book")
