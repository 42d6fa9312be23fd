"""Line dedup by winnowing over line hashes (operator 10).

A text's lines are hashed. A run counts from ``least`` words on; from each line a gram reaches forward
to half of that. The least gram hash in every window of as many words of gram starts is selected, so
any repeated run of whole lines with ``least`` words contains a selected gram (the winnowing
guarantee). Positions are joined on grams; where a gram occurs twice, the match is extended both ways,
line by line, to the runs of ``least`` words that contain it, and every such run that has an earlier
occurrence is deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import WHITE, batch_bytes, byte_set, mix, prefix_hash, signed, slices, spans
from .store import apart, columns, stage, table, text_key, unused

#: Words of the shortest run that is deleted, where no other number is given.
LEAST = 50
#: The same for the registered query, which takes single repeated lines, too.
LEAST_LINE = 8
NEWLINE = byte_set([0x0A])


def line_table(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and word count of every line of a batch of texts, and the number of each text's first
    line (one more entry: how many lines there are). Every text, even an empty one, has a line."""
    raw, off = batch_bytes(column)
    breaks = np.flatnonzero(raw == 0x0A)
    starts = np.sort(np.concatenate((off[:-1], breaks + 1)), kind="stable")
    # A break that ends a text starts a line at the next text's offset: in the sorted starts it
    # belongs to the earlier text, which the counts below see to.
    number = np.arange(len(off) - 1) + np.searchsorted(breaks, off[:-1])
    first = np.append(number, len(starts))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = off[1:]
    h, inv = prefix_hash(raw)
    hashed = mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64), 31)
    word_starts, _, _ = spans(raw, off, WHITE)
    words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    return hashed, words, first


def _run_hashes(hashed: np.ndarray):
    """``f(a, b)``: the hash of the run of lines a to b, both included, wherever it stands."""
    power = np.full(len(hashed) + 1, 0xD1342543DE82EF95, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    back = np.full(len(hashed) + 1, pow(0xD1342543DE82EF95, -1, 2**64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed * power[:-1], dtype=np.uint64)))
    return lambda a, b: mix((total[b + 1] - total[a]) * back[a] + (b - a + 1).astype(np.uint64), 32)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers low to high (left out) of each pair in a row, and whose they are."""
    many = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), many)
    return np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + low[owner], owner


def _least_in(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of the leftmost least value of each stretch low to high (included), by a table of the
    minima of stretches of 1, 2, 4, ... values."""
    out, size = np.empty(len(low), np.int64), high - low + 1
    at, width = np.arange(len(x)), 1
    while len(low):
        some = np.flatnonzero((size >= width) & (size < 2 * width))
        p, q = at[low[some]], at[high[some] - width + 1]
        out[some] = np.where(x[q] < x[p], q, p)
        if not (size >= 2 * width).any():
            break
        p, q = at[:-width], at[width:]
        at = np.append(np.where(x[q] < x[p], q, p), at[len(at) - width :])
        width *= 2
    return out


def winnow(hashed: np.ndarray, words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """The selected grams of a batch of texts (``first``: their first lines): number of the text, line in
    the text and hash of each gram, and of each gram's runs, in a row, how many there are, and their
    hashes, first and last lines: the least runs of ``least`` words, from their first line on or
    from their last line back, that contain the gram."""
    n, gram = len(hashed), max(1, least // 2)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, end = first[:-1][text], first[1:][text]
    total = np.concatenate(([0], np.cumsum(words)))
    run = _run_hashes(hashed)
    reach = np.searchsorted(total, total[:-1] + gram) - 1  # last line of the gram from each line
    whole = np.searchsorted(total, total[:-1] + least) - 1
    has = reach < end
    grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    grams[has] = run(np.flatnonzero(has), reach[has])
    starts = first[:-1] + np.bincount(text[has], minlength=len(first) - 1)  # lines from here on start no gram
    i = np.flatnonzero(whole < end)
    s = np.unique(_least_in(grams, i, np.minimum(reach[i], starts[text[i]] - 1)))
    g = reach[s]
    # Extended to the left up to least words, then no further to the right than needed; and the other
    # way about, so that the last lines of a longer run are in one of these, too.
    a, of_a = _spread(np.maximum(begin[s], np.searchsorted(total, total[s] - least, "right")), s + 1)
    ok = (whole[a] >= g[of_a]) & (whole[a] < end[s][of_a])
    a, of_a = a[ok], of_a[ok]
    d, of_d = _spread(g, np.minimum(end[s], np.searchsorted(total, total[g + 1] + least) + 1))
    c = np.searchsorted(total, total[d + 1] - least, "right") - 1
    ok = (c >= begin[s][of_d]) & ((c <= s[of_d]) | (d == g[of_d]))
    c, d, of_d = np.minimum(c, s[of_d])[ok], d[ok], of_d[ok]
    left, right, owner = np.concatenate((a, c)), np.concatenate((whole[a], d)), np.concatenate((of_a, of_d))
    order = np.lexsort((right, left, owner))
    left, right, owner = left[order], right[order], owner[order]
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(left) != 0) | (np.diff(right) != 0)) if len(order) else np.zeros(0, bool)
    left, right, owner = left[new], right[new], owner[new]
    many = np.bincount(owner, minlength=len(s))
    kept = many > 0
    s, many = s[kept], many[kept]
    base = begin[left] if len(left) else left
    return text[s], s - begin[s], signed(grams[s]), many, signed(run(left, right)), left - base, right - base


def _grams(least):
    def run(batches):
        for part in slices(batches, "text"):
            text, at, gram, many, runs, a, b = winnow(*line_table(part.column("text")), least)
            if not len(text):
                continue
            ids = part.select(["doc_id", "_row"]).take(pa.array(text))
            off = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(gram), pa.array(at), *(pa.ListArray.from_arrays(off, pa.array(x.astype(np.int64))) for x in (runs, a, b))],
                                             ["doc_id", "_row", "gram", "at", "run", "first", "last"])
    return run


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(doc_id, _row, cuts)``: for each document with later repeats, its runs as an array of
    structs (first, last line)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("_row"))
    found = stage(source.mapInArrow(_grams(least), "doc_id long, _row long, gram long, at long, run array<long>, first array<long>, last array<long>"), "grams")
    # Grams that stand in two places; equal rows are one document. Counted before the shuffle.
    place = F.struct("doc_id", "_row", "at")
    twice = found.groupBy("gram").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("gram")
    runs = found.join(apart(twice, "gram"), "gram").select("doc_id", "_row", F.explode(F.arrays_zip("run", "first", "last")).alias("r")).select("doc_id", "_row", "r.run", "r.first", "r.last")
    runs = stage(runs, "runs")
    here = F.struct("doc_id", "first", "_row")
    earliest = runs.groupBy("run").agg(F.min(here).alias("original"), F.max(here).alias("latest")).where("original <> latest").select("run", "original")
    later = runs.join(apart(earliest, "run"), "run").where(here > F.col("original")).select("doc_id", "_row", "first", "last").distinct()
    return later.groupBy("doc_id", "_row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cuts"))


def _cut(names, cuts_name):
    def run(batches):
        for batch in batches:
            texts, cuts = batch.column("text").to_pylist(), batch.column(cuts_name).to_pylist()
            removed = []
            for k, cut in enumerate(cuts):
                gone: set[int] = set()
                for c in cut or ():
                    gone.update(range(c["first"], c["last"] + 1))
                removed.append(len(gone))
                if gone:
                    texts[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in gone)
            made = {"text": pa.array(texts, pa.string()), names[-1]: pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)
    return run


def dedup_lines(docs: DataFrame, min_words: int = LEAST, removed: str = "_removed") -> DataFrame:
    """Every document with the later repeats of runs of whole lines taken out of its text, and the
    number of lines taken as ``removed``; the other columns stay, whatever their names.

    A line is deleted if it lies in a run of consecutive whole lines with ``min_words`` words or more that
    also occurs earlier: in a document of smaller doc_id, or further up in the same one (judged on
    the input, not on what is left; lines are equal byte for byte and split at newlines only; a
    tie of doc_id goes by line and then by the text's hash). Shorter repeats stay, and so does the
    first occurrence. Null and empty texts have no words and stay; rows equal in doc_id and text
    are one document; a null doc_id counts as before all others. Empty table: no rows. A text that
    loses all lines becomes empty; its row stays. A column that already has the name ``removed`` is
    an error.
    """
    if min_words < 1:
        raise ValueError("a run has one word at least")
    if removed in docs.columns:
        raise ValueError(f"the documents have a column {removed} of their own")
    d, r, key, cut = unused(docs.withColumn(removed, F.lit(0)), "d", "r", "key", "cuts")
    cuts = repeated_runs(docs, min_words).select(F.col("doc_id").alias(d), F.col("_row").alias(r), F.col("cuts").alias(cut))
    keyed = docs.withColumn(key, text_key())
    joined = keyed.join(cuts, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(r)), "left")
    schema = T.StructType([*docs.schema.fields, T.StructField(removed, T.LongType())])
    return joined.select(*columns(docs.columns), cut).mapInArrow(_cut([f.name for f in schema.fields], cut), schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the SHA-256 of the text that is left, without the
    repeats of ``LEAST_LINE`` words and more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = dedup_lines(docs, LEAST_LINE)
    return out.select("doc_id", "n_lines", F.col("_removed").alias("n_removed"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
