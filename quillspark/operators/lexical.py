"""Measures of a block: sentence length, Simpson's index, Honoré's measure, keywords, function words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import STOPWORDS
from .blocks import OVERLAP, SIZE, Counts, blocks, check, panes, token_panes


def binary_round(c: Column, n: int) -> Column:
    """Half up, by the product with a power of ten as it is in binary; ``F.round`` goes by the decimal digits that a
    number is printed with, and SQL engines differ in halves."""
    return F.round(c * float(10**n)) / float(10**n)


def sentence_length(text: Column) -> Column:
    """Tokens per sentence; 0 without sentences."""
    n = T.sentence_count(text)
    return F.when(n > 0, F.size(T.tokens(text)) / n).otherwise(F.lit(0.0))


_MEASURES = "array<struct<n_tokens: bigint, n_types: bigint, n_hapax: bigint, pairs: bigint, keywords: array<struct<tok: string, n: bigint>>>>"


def measured(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id", keywords: int = 0) -> DataFrame:
    """``(key, _w, _m)``: of each text its words and an array of its blocks' counts, see ``counts_of_block``, with
    the ``keywords`` commonest tokens that aren't stopwords; ties by first place. No shuffle."""
    step = check(size, overlap)

    def measures(texts: pa.Array) -> pa.Array:
        c = Counts(texts, size, step)
        blocks = len(c.doc)
        n_types, n_hapax, pairs, listed = (np.zeros(blocks, np.int64) for _ in range(4))
        stop = pc.is_in(c.tokens, value_set=pa.array(STOPWORDS)).to_numpy(zero_copy_only=False)
        tok, number = [], []
        for lo, hi, row, code, n, first in c.runs():
            sums = lambda x: np.bincount(row, x, hi - lo).astype(np.int64)  # noqa: B023, E731
            n_types[lo:hi], n_hapax[lo:hi], pairs[lo:hi] = sums(None), sums(n == 1), sums(n * (n - 1))
            if keywords:
                content = np.flatnonzero(~stop[code])
                content = content[np.lexsort((first[content], -n[content], row[content]))]
                of = np.bincount(row[content], minlength=hi - lo)
                content = content[np.arange(len(content)) - np.repeat(np.cumsum(of) - of, of) < keywords]
                listed[lo:hi] = np.minimum(of, keywords)
                tok.append(code[content])
                number.append(n[content])
        code, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tok, number))
        words = pa.StructArray.from_arrays([c.tokens.take(pa.array(code)), pa.array(n, pa.int64())], ["tok", "n"])
        words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(listed)), pa.int32()), words)
        return _by_text(c, [c.stop - c.start, n_types, n_hapax, pairs, words], ["n_tokens", "n_types", "n_hapax", "pairs", "keywords"])

    return docs.select(key, T.words(F.col("text")).alias("_w")).withColumn("_m", _once(measures, _MEASURES)(panes(F.col("_w"), size, step)))


def _once(f, kind: str):
    """A function of Arrow arrays. A filter on what it returns would otherwise call it a second time, below itself."""
    return F.arrow_udf(f, kind).asNondeterministic()


def _by_text(c: Counts, columns: list, names: list[str]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, c.ends), pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in columns], names))


def simpson(m: Column) -> Column:
    """Simpson's D of a block's counts; 0 for fewer than two tokens."""
    total = m["n_tokens"].cast("double")
    return F.when(m["n_tokens"] >= 2, m["pairs"] / (total * (total - 1))).otherwise(F.lit(0.0))


def honore(m: Column) -> Column:
    """Honoré's R of a block's counts; 0 without tokens or where every word stands once."""
    return F.when(m["n_hapax"] < m["n_types"], 100 * F.log(m["n_tokens"].cast("double")) / (1 - m["n_hapax"] / m["n_types"])).otherwise(F.lit(0.0))


def lexical_richness(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """N, V, V1, D and R of every block; blocks without tokens and texts without a key have zeros."""
    m, named = F.col("m"), F.col(key).isNotNull()
    rows = measured(docs, size, overlap, key).select(key, F.posexplode("_m").alias("block", "m"))
    zero = lambda c, name: F.when(named, c).otherwise(F.lit(0)).alias(name)
    return rows.select(key, "block", *[zero(m[c], c) for c in ("n_tokens", "n_types", "n_hapax")], zero(simpson(m), "simpson"), zero(honore(m), "honore"))


def keyword_rows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id", n: int = 5) -> DataFrame:
    """``(key, block, rank, tok, n)``: ``top_keywords`` of every block, found where its text lies."""
    rows = measured(docs, size, overlap, key, n).select(key, F.posexplode("_m").alias("block", "m")).select(key, "block", F.posexplode("m.keywords").alias("_k", "k"))
    return rows.select(key, "block", (F.col("_k") + 1).alias("rank"), "k.tok", "k.n")


def sentence_lengths(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    b = blocks(docs, size, overlap, key)
    return b.select(key, "block", F.size(T.tokens(F.col("block_text"))).cast("long").alias("n_tokens"), T.sentence_count(F.col("block_text")).cast("long").alias("n_sentences"), sentence_length(F.col("block_text")).alias("sentence_length"))


def top_keywords(counts: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """``(keys, rank, tok, n)``: the commonest tokens that aren't stopwords; ties by first place."""
    content = counts.where(~F.col("tok").isin(STOPWORDS))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first")
    return content.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(*keys, "rank", "tok", "n")


def function_words(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """``(key, block, tok, n)``: counts of function words of two characters and more (shorter ones are
    never counted). Words that don't occur have no row."""
    return token_panes(docs, size, overlap, key, tokens=T.counted_tokens, only=STOPWORDS).select(key, "block", "tok", "n")


def function_word_vectors(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """``(key, block, vector)``: of every block the counts of all function words in the order of the
    list, 0 for those that don't occur."""
    step, width = check(size, overlap), len(_VOCABULARY)

    def vectors(texts: pa.Array) -> pa.Array:
        c = Counts(texts, size, step, _VOCABULARY)
        cells = _cells(c).ravel()
        return _by_text(c, [pa.ListArray.from_arrays(pa.array(np.arange(len(c.doc) + 1) * width, pa.int32()), pa.array(cells))], ["vector"])

    words = docs.select(key, T.words(F.col("text")).alias("_w"))
    out = words.select(key, _once(vectors, "array<struct<vector: array<bigint>>>")(panes(F.col("_w"), size, step, T.counted_tokens)).alias("_v"))
    return out.select(key, F.posexplode("_v").alias("block", "v")).select(key, "block", "v.vector")


#: Function words in the order of vectors.
_VOCABULARY = list(dict.fromkeys(STOPWORDS))


def _cells(c: Counts) -> np.ndarray:
    """Counts of all function words, a row a block."""
    out = np.zeros((len(c.doc), len(_VOCABULARY)), np.int64)
    place = pc.index_in(c.tokens, value_set=pa.array(_VOCABULARY)).fill_null(0).to_numpy()
    for lo, _, row, code, n, _ in c.runs():
        out[lo + row, place[code]] = n
    return out


def principal_plane(matrix: np.ndarray) -> np.ndarray:
    """Scores on the first two principal components of the centred rows, each component's largest
    loading positive; zeros where there are fewer than two rows."""
    if len(matrix) < 2:
        return np.zeros((len(matrix), 2))
    centred = matrix - matrix.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    axes = vt[:2]
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]
    out = np.zeros((len(matrix), 2))
    out[:, : len(axes)] = centred @ axes.T
    return out


def planes(words: Column, size: int, step: int) -> Column:
    """``array<struct<pc1, pc2>>``: the plane fitted per text over its blocks' function words, by block."""
    def plane(texts: pa.Array) -> pa.Array:
        c = Counts(texts, size, step, _VOCABULARY)
        cells = _cells(c)
        xy = np.concatenate([np.zeros((0, 2)), *[principal_plane(cells[end - n : end].astype(float)) for n, end in zip(c.number, c.ends) if n]])
        return _by_text(c, [xy[:, 0], xy[:, 1]], ["pc1", "pc2"])

    return _once(plane, "array<struct<pc1: double, pc2: double>>")(panes(words, size, step, T.counted_tokens))


def pca_coordinates(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """``(key, block, pc1, pc2)``: the plane of every block."""
    words = docs.select(key, T.words(F.col("text")).alias("_w"))
    out = words.select(key, planes(F.col("_w"), size, check(size, overlap)).alias("_p"))
    return out.select(key, F.posexplode("_p").alias("block", "p")).select(key, "block", "p.pc1", "p.pc2")
