"""A training-corpus pipeline: toxicity, line dedup, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from quillspark.llm.store import columns, stage, table, unused



def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the CRF scores at the threshold or over; the others stay as they are."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = unused(docs, "score", "spans")
    return toxicity.score(docs, model, docs.columns, names).where(F.col(names[0]) < toxicity.THRESHOLD).select(*columns(docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later repeats of runs of lines out of the texts; ``n_chars`` follows. Documents stay,
    unless nothing but white space is left of one that had more."""
    (removed,) = unused(docs, "removed")
    out = line_dedup.dedup_lines(docs, removed=removed)
    gone = (F.col(removed) > 0) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    out = out.where(~gone | F.col("text").isNull())
    n_chars = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.withColumn("n_chars", n_chars).select(*columns(docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at Jaccard 0.8 of word 5-grams: the one of smallest doc_id."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says: never (rate 0), once or more. The targets are
    those of the query, 95 and 5 per cent of the tokens."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as digests beside their number."""
    out = bpe.encode(docs, ["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("soft_mixing", mix_sources),
    ("bpe", encode_texts),
]

#: SQL can't express the learned stages; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
