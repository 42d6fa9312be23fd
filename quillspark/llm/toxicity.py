"""Toxic spans by a linear-chain conditional random field (operator 7).

Token labels come from the labelled table: words that stand in far more toxic than clean training
documents are toxic tokens where the document is marked toxic. A two-tag CRF (clean, toxic) is
trained on these by gradient ascent of its exact log-likelihood; forward-backward marginals give each
token's probability, whose aggregates a logistic layer, fitted on the same training rows, turns
into the document score. Offsets of tokens over one half are the offending spans.

Training is one task's work over a bounded sample of labelled rows (``SAMPLE`` of each label, those of
least hash, as far as their texts fit ``SAMPLE_BYTES``); the model is the weights of their words,
broadcast with the task. A text is one chain, in training and scoring, however long.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import CODES, LOWER, batch_bytes, byte_set, slices, span_hashes, spans
from .store import columns, table, unused

#: Labelled training rows of each label at most: a bounded, documented sample.
SAMPLE = 1500
#: Bytes of these rows' texts at most, those of least hash first.
SAMPLE_BYTES = 24 << 20
#: Tokens that are summed up into one 2 x 2 transfer, so that long chains run in parallel.
PIECE = 128
THRESHOLD = 0.7
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))

# A token is a run of ASCII letters and bytes of other scripts, lower-cased within A-Z.
SEPARATORS = ~byte_set([*range(65, 91), *range(97, 123), *range(128, 256)])
CODES_LOWER = CODES[LOWER]


U = np.uint64


@dataclass
class Model:
    words: np.ndarray  # sorted word hashes
    emission: np.ndarray  # toxic minus clean score of each word; one more entry: unknown words
    transition: np.ndarray  # 2 x 2
    start: np.ndarray  # 2
    layer: np.ndarray  # logistic weights of features()


def tokens(column: pa.Array):
    """Word hashes, byte spans within the batch, and each text's first token (and the end)."""
    raw, off = batch_bytes(column)
    starts, ends, first = spans(raw, off, SEPARATORS)
    return span_hashes(raw, starts, ends, CODES_LOWER), starts, ends, first, off


def lookup(words: np.ndarray, w: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(len(w), np.int64)
    k = np.minimum(np.searchsorted(words, w), len(words) - 1)
    return np.where(words[k] == w, k, len(words))


def chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the texts that have tokens: each is tagged as one sequence."""
    size = np.diff(first)
    return first[:-1][size > 0], size[size > 0]


def forward_backward(unary: np.ndarray, start: np.ndarray, length: np.ndarray, trans: np.ndarray, initial: np.ndarray):
    """Marginal probability of the toxic tag of every token, the log-partition sum and the expected
    transition and initial counts, over all chains at once (scaled, in probability space).

    Chains run in pieces of ``PIECE`` tokens side by side: a piece's product of 2 x 2 transfers tells what
    reaches it from the left and the right, so the result is that of the uncut chain.
    """
    if not len(start):
        return np.zeros(0), 0.0, np.zeros((2, 2)), np.zeros(2)
    parts = -(-length // PIECE)
    chain = np.repeat(np.arange(len(start)), parts)
    base = np.cumsum(parts) - parts
    at = np.arange(len(chain)) - base[chain]
    begin = start[chain] + at * PIECE
    size = np.minimum(PIECE, start[chain] + length[chain] - begin)
    order = np.argsort(-size, kind="stable")
    begin, size, opens = begin[order], size[order], at[order] == 0
    n, m = len(order), int(size.max())
    alive = np.searchsorted(-size, -np.arange(m), "left")  # pieces longer than t
    top = np.maximum(unary, 0)
    em = np.stack((np.exp(-top), np.exp(unary - top)), 1)
    e, s = np.exp(trans), np.exp(initial)
    come, go = np.empty((n, 2)), np.ones((n, 2))  # what enters a piece, and what leaves it
    if parts.max() > 1:
        whole = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
        for t in range(m):
            k = alive[t]
            step = np.where(opens[:k, None, None], whole[:k], whole[:k] @ e) if t == 0 else whole[:k] @ e
            whole[:k] = step * em[begin[:k] + t][:, None, :]
            whole[:k] /= whole[:k].sum((1, 2), keepdims=True)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        flow = np.broadcast_to(s, (len(start), 2)).copy()
        for j in range(int(parts.max())):
            c = np.flatnonzero(parts > j)
            r = rank[base[c] + j]
            come[r] = flow[c]
            out = (flow[c][:, None, :] @ whole[r])[:, 0]
            flow[c] = out / out.sum(1, keepdims=True)
        flow = np.ones((len(start), 2))
        for j in range(int(parts.max()) - 1, -1, -1):
            c = np.flatnonzero(parts > j)
            r = rank[base[c] + j]
            go[r] = flow[c]
            back = (whole[r] @ flow[c][:, :, None])[:, :, 0]
            flow[c] = back / back.sum(1, keepdims=True)
    a = np.zeros((m, n, 2))
    z = float(top.sum())
    for t in range(m):
        k = alive[t]
        before = np.where(opens[:, None], s, come @ e) if t == 0 else a[t - 1, :k] @ e
        x = before * em[begin[:k] + t]
        c = x.sum(1, keepdims=True)
        a[t, :k] = x / c
        z += float(np.log(c).sum())
    p = np.zeros(len(unary))
    pair, first = np.zeros((2, 2)), np.zeros(2)
    b = go
    for t in range(m - 1, -1, -1):
        k = alive[t]
        g = a[t, :k] * b[:k]
        g /= g.sum(1, keepdims=True)
        p[begin[:k] + t] = g[:, 1]
        inner = slice(0, k) if t else np.flatnonzero(~opens)
        left = a[t - 1, :k] if t else come[inner]
        y = em[begin[inner] + t] * b[inner]
        w = left[:, :, None] * e * y[:, None, :]
        pair += (w / w.sum((1, 2), keepdims=True)).sum(0)
        if t:
            b[:k] = y @ e.T
            b[:k] /= b[:k].sum(1, keepdims=True)
        else:
            first = g[opens].sum(0)
    return p, z, pair, first


def features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document, from its tokens' marginals: 1, the largest, the logs of the sum of strong ones
    and of their share, whether there is any."""
    n = len(first) - 1
    out = np.zeros((n, 5))
    out[:, 0] = 1
    strong = np.where(p > 0.25, p, 0.0)
    total = np.concatenate(([0.0], np.cumsum(strong)))
    s = np.maximum(total[first[1:]] - total[first[:-1]], 0)
    size = np.diff(first)
    some = size > 0
    if some.any():
        out[some, 1] = np.maximum.reduceat(np.append(p, 0), first[:-1][some])
    out[:, 2] = np.log1p(s)
    out[:, 3] = np.log1p(1000 * s / np.maximum(size, 20))
    out[:, 4] = s > 0.4
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _all_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and first tokens of many texts, made a few at a time."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    for part in slices([batch], "text"):
        w, _, _, first, _ = tokens(part.column("text"))
        parts.append(w)
        sizes.append(np.diff(first))
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def train(texts: list[str | None], toxic: list[int], rounds: int = 20) -> Model:
    """Fit the CRF and the document layer. With one label only, or no rows, the score is that
    label's smoothed share everywhere."""
    y = np.array(toxic, float)
    w, first = _all_tokens(texts)
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    prior = (y.sum() + 0.5) / (len(y) + 1)
    empty = Model(np.zeros(0, np.uint64), np.zeros(1), np.zeros((2, 2)), np.array([0.0, -30.0]), np.array([np.log(prior / (1 - prior)), 0, 0, 0, 0]))
    if not len(w) or y.min() == y.max():
        return empty
    vocab, at = np.unique(w, return_inverse=True)
    seen = np.unique(at.astype(np.int64) * len(y) + doc)
    word, where = seen // len(y), seen % len(y)
    df = np.bincount(word, minlength=len(vocab))
    tox = np.bincount(word, y[where], minlength=len(vocab))
    # Copies of one text would make all its words look toxic: a word counts in toxic documents
    # as often at most as it has different left neighbours there.
    left = np.where(np.isin(np.arange(len(w)), first[:-1]), U(0), np.roll(w, 1))
    in_toxic = y[doc] > 0
    pairs, left = at[in_toxic].astype(np.int64), left[in_toxic]
    order = np.lexsort((left, pairs))
    pairs, left = pairs[order], left[order]
    pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]) | (left[1:] != left[:-1]))]
    tox = np.minimum(tox, np.bincount(pairs, minlength=len(vocab)))
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = np.log((tox + 0.3) / (n1 + 0.6)) - np.log((df - tox + 0.3) / (n0 + 0.6))
    # A toxic word is far likelier in toxic documents, by more than chance could do.
    share = n1 / len(y)
    sigma = (tox - df * share) / np.sqrt(df * share * (1 - share) + 1e-9)
    marked = (odds > 1.5) & (sigma > 4.5) & (tox >= max(3, 0.01 * n1))
    ids = lookup(vocab, w)
    gold = np.append(marked, False)[ids] & (y[doc] > 0)
    start, length = chains(first)
    nv = len(vocab) + 1
    emission, trans, initial = np.full(nv, -2.0), np.zeros((2, 2)), np.zeros(2)
    g = gold.astype(int)
    inner = np.ones(len(w), bool)
    inner[start + length - 1] = False
    inner = np.flatnonzero(inner)
    want_pair = np.zeros((2, 2))
    np.add.at(want_pair, (g[inner], g[inner + 1]), 1)
    want_first = np.bincount(g[start], minlength=2).astype(float)
    want = np.bincount(ids, g, minlength=nv)
    many = np.bincount(ids, minlength=nv) + 4.0
    for _ in range(rounds):  # gradient ascent, each weight scaled by how often it is seen
        p, _, pair, now_first = forward_backward(emission[ids], start, length, trans, initial)
        emission += np.clip(6 * (want - np.bincount(ids, p, minlength=nv) - 0.02 * emission) / many, -1.5, 1.5)
        trans += np.clip(2 * (want_pair - pair) / (want_pair + 50.0), -0.5, 0.5)
        initial += np.clip(2 * (want_first - now_first) / (want_first + 50.0), -0.5, 0.5)
    emission[-1] = min(emission[-1], float(np.median(emission)))
    p, *_ = forward_backward(emission[ids], *chains(first), trans, initial)
    x = features(p, first)
    beta = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps of a ridge logistic regression
        q = _sigmoid(x @ beta)
        grad = x.T @ (y - q) - beta
        hess = (x * (q * (1 - q))[:, None]).T @ x + np.eye(len(beta))
        beta = beta + np.linalg.solve(hess, grad)
    return Model(vocab, emission, trans, initial, beta)


def apply(model: Model, column: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores of a batch of texts, and their toxic tokens as byte offsets within each text."""
    w, starts, ends, first, off = tokens(column)
    p, *_ = forward_backward(model.emission[lookup(model.words, w)], *chains(first), model.transition, model.start)
    score = _sigmoid(features(p, first) @ model.layer)
    out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    for k in np.flatnonzero(p > 0.5):
        d = int(np.searchsorted(first, k, "right")) - 1
        out[d].append({"start": int(starts[k] - off[d]), "end": int(ends[k] - off[d]), "p": float(p[k])})
    return score, out


FIELDS = ("words", "emission", "transition", "start", "layer")


def packed(model: Model) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f: getattr(model, f) for f in FIELDS})
    return out.getvalue()


def unpacked(data: bytes) -> Model:
    with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
        return Model(*(arrays[f] for f in FIELDS))


def _trained(batches):
    rows = [b for b in batches if b.num_rows]
    if rows:
        t = pa.Table.from_batches(rows).sort_by("doc_id")
        yield pa.RecordBatch.from_arrays([pa.array([packed(train(t.column("text").to_pylist(), t.column("toxic").to_pylist()))], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train, in one task, on labelled rows whose crc32(doc_id) mod 3 is not 1: at most ``sample`` of each label,
    those of least hash of doc_id, so the choice is the same on every run and cluster, and of these
    as many as have ``SAMPLE_BYTES`` of text. Rows with a null label are not used; of rows that
    repeat a doc_id, one label (the larger) and one text (the smallest) count."""
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL AND pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) <> 1")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value in (0, 1):  # a top-k by hash each, not a sort of all rows
        part = usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 * sample ids: the bounded side is broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("size", size).where(F.col("size") <= SAMPLE_BYTES).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"))
    found = rows.mapInArrow(_trained, "model binary").collect()
    return unpacked(found[0].model) if found else train([], [])


def score(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("score", "spans")) -> DataFrame:
    """One row per input row: the ``keep`` columns, a score (0 to 1) and spans (byte offsets and
    probability of each toxic token) under the two ``names``, which no column of ``keep`` may have.
    Null and empty texts have no tokens: the score of a text without toxic words. No shuffle;
    repeated rows are scored each; columns not in ``keep`` are not read, whatever their names."""
    kept = docs.select(*columns(keep))
    schema = kept.schema.add(names[0], "double").add(names[1], SPANS)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
    out_names = [f.name for f in schema.fields]
    (text,) = unused(kept, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches, text):
            s, spans_ = apply(shared.value, part.column(text))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(s), pa.array(spans_, kind)], out_names)

    return docs.select(*columns(keep), F.col("text").alias(text)).mapInArrow(run, schema)


HELD_OUT = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) = 1"


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
