"""Sliding word windows. ``size`` words a block, ``overlap`` shared with the one before; a tail shorter
than a block is dropped, so a shorter document has no blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SIZE, OVERLAP = 10_000, 9_000


def check(size: int, overlap: int) -> int:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("a block needs a size of 1 or more and a smaller overlap that isn't negative")
    return size - overlap


def starts(words: Column, size: int, step: int) -> Column:
    """Block numbers of a word array; empty where there are too few words."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.floor((F.size(words) - size) / step).cast("int"))).otherwise(F.array().cast("array<int>"))


def blocks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, block, words, block_text)``, a row a block. No shuffle."""
    step = check(size, overlap)
    split = docs.select(key, T.words(F.col(text)).alias("_w"))
    out = split.select(key, F.explode(starts(F.col("_w"), size, step)).alias("block"), "_w")
    return out.select(key, "block", F.slice("_w", F.col("block") * step + 1, size).alias("words")).withColumn("block_text", F.array_join("words", " "))


def panes(words: Column, size: int, step: int, tokens=T.tokens) -> Column:
    """Tokens of a word array by pane: an array for each of the pieces of which all blocks are made up. They are as
    wide as the greatest common divisor of size and step; empty where there are too few words.
    ``tokens`` never hold white space, so that a pane's are those of its words."""
    wide = math.gcd(size, step)
    count = ((F.floor((F.size(words) - size) / step) * step + size) / wide).cast("int")
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda p: tokens(F.array_join(F.slice(words, p * wide + 1, wide), " ")))
    return F.when(F.size(words) >= size, each).otherwise(F.array().cast("array<array<string>>"))


class Counts:
    """The tokens of a batch of texts, given as lists of panes. ``doc`` and ``block`` number the blocks of all texts,
    ``ends`` tells where those of each text end. Blocks are counted a run at a time, so that memory hangs on the
    batch and not on how often blocks overlap."""

    RUN = 1 << 19

    def __init__(self, batch: pa.ListArray, size: int, step: int, only: list[str] | None = None):
        many, hop = size // math.gcd(size, step), step // math.gcd(size, step)
        at = batch.offsets.to_numpy()
        self.number = np.where(np.diff(at) >= many, (np.diff(at) - many) // hop + 1, 0)
        self.ends = np.cumsum(self.number)
        self.doc = np.repeat(np.arange(len(self.number)), self.number)
        self.block = np.arange(len(self.doc)) - np.repeat(self.ends - self.number, self.number)
        places = batch.values.offsets.to_numpy() if len(batch.values) else np.zeros(1, np.int32)
        begin = at[self.doc] + self.block * hop
        self.start, self.stop = places[begin].astype(np.int64), places[begin + many].astype(np.int64)
        found = batch.values.values.slice(places[at[0]], places[at[-1]] - places[at[0]]).dictionary_encode()
        self.start -= places[at[0]]
        self.stop -= places[at[0]]
        self.tokens, self.code = found.dictionary, found.indices.to_numpy()
        self.wanted = None if only is None else pc.is_in(self.tokens, value_set=pa.array(only, pa.string())).to_numpy(zero_copy_only=False)

    def runs(self):
        """``(lo, hi, row, code, n, first)``: of blocks lo to hi the block (from 0 in the run), code, number and first
        place of each distinct token, in order of blocks."""
        size = self.stop - self.start
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // self.RUN)) + 1), len(size)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            part = size[lo:hi]
            row = np.repeat(np.arange(hi - lo), part)
            place = np.arange(len(row)) + np.repeat(self.start[lo:hi] - (np.cumsum(part) - part), part)
            code = self.code[place]
            if self.wanted is not None:
                keep = self.wanted[code]
                row, place, code = row[keep], place[keep], code[keep]
            key = row * max(1, len(self.tokens)) + code
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.diff(key, prepend=-1))
            yield lo, hi, row[order][new], code[order][new], np.diff(new, append=len(key)), place[order][new]


def token_panes(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text", tokens=T.tokens, only: list[str] | None = None) -> DataFrame:
    """``(key, block, tok, n, first)``: how often a token stands in a block, and its first place.
    ``tokens``: what a text's tokens are; ``only``: the tokens that count, all by default. No shuffle: texts are
    tokenised by panes and counted where they lie, ``key`` names one text."""
    step = check(size, overlap)
    kind = dict(docs.dtypes)[key]

    def count(batches):
        for batch in batches:
            c = Counts(batch.column("_panes"), size, step, only)
            for lo, _, row, code, n, first in c.runs():
                doc = pa.array(c.doc[lo + row])
                yield pa.record_batch([batch.column(key).take(doc), pa.array(c.block[lo + row], pa.int32()), c.tokens.take(pa.array(code)), pa.array(n, pa.int64()), pa.array(first, pa.int64())], [key, "block", "tok", "n", "first"])

    return docs.select(key, T.words(F.col(text)).alias("_w")).select(key, panes(F.col("_w"), size, step, tokens).alias("_panes")).mapInArrow(count, f"{key} {kind}, block int, tok string, n long, first long")
