"""Removal of long repeated substrings with a run-length index (operator 2).

Texts are too many for one index, so candidates are dealt out first. Every window of ``LENGTH`` bytes
selects an anchor, the string of ``ANCHOR`` bytes in it of least hash: equal windows select equal
anchors at equal offsets, so only texts around an anchor that stands in two places can repeat. These
contexts, equal ones taken once with their number, are indexed per anchor: suffixes are sorted,
the Burrows-Wheeler transform is taken in runs, and match lengths are computed at the ends of runs
only. Streaming over the text, the length of the longest match elsewhere falls by one from byte to
byte except at those samples (the matching statistics); windows with ``LENGTH`` or more are marked.

An anchor with more than ``PART`` different contexts is split without pairing parts: a window lies
some bytes left of its anchor, equal windows equally many, so contexts are cut into the stretches
of windows whose distance lies in one interval, and dealt out by the bytes that all windows of an
interval have in common. Each window stands in one stretch, and equal windows in one group, so a
context never meets a copy of itself. Groups still over ``PART`` are cut into smaller intervals, in
the end into single windows, which are equal within a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import batch_bytes, mix, prefix_hash, signed, slices
from .store import apart, stage, table, text_key

LENGTH, ANCHOR = 400, 300
#: Different contexts of one group up to which one index takes them; more are split by intervals of
#: so many distances between a window and its anchor.
PART, INTERVALS = 1024, (25, 6, 1)
#: Shares in which the places of one anchor are counted before they meet.
SHARES = 256
#: Bytes of one index, about: contexts of several anchors share one.
INDEX = 1 << 20


# --- anchors ----------------------------------------------------------------------------------


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each window, by block prefixes and suffixes."""
    n = len(x)
    pad = -n % width
    big = np.append(x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    pos = np.arange(n + pad).reshape(-1, width)
    fore = np.minimum.accumulate(big, 1)
    back = np.minimum.accumulate(big[:, ::-1], 1)[:, ::-1]
    # Leftmost position of each running minimum.
    fresh = np.concatenate((np.ones((len(big), 1), bool), fore[:, 1:] < fore[:, :-1]), 1)
    fore_at = np.maximum.accumulate(np.where(fresh, pos, -1), 1)
    own = np.where(big == back, pos, n + pad)
    back_at = np.minimum.accumulate(own[:, ::-1], 1)[:, ::-1]
    # A suffix's minimum is at the first position from there on that equals it.
    flat, flat_b, at_f, at_b = fore.ravel(), back.ravel(), fore_at.ravel(), back_at.ravel()
    i = np.arange(n - width + 1)
    j = i + width - 1
    return np.where(flat_b[i] <= flat[j], at_b[i], at_f[j])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text of a window or more: hashes of the selected anchors, hashes of their contexts (the
    windows that select one in a row) and of the anchor's place in them, first start and number of
    further starts of these windows, and how far in the context its anchor starts."""
    n = len(raw)
    h, inv = prefix_hash(raw)
    grams = mix((h[ANCHOR:] - h[: n - ANCHOR + 1]) * inv[: n - ANCHOR + 1], 41)
    chosen = window_minimum(grams, LENGTH - ANCHOR + 1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
    last = np.append(first[1:] - 1, len(chosen) - 1)
    lead = chosen[first] - first
    view, digest = memoryview(raw.tobytes()), xxhash.xxh3_64_intdigest
    whole = np.fromiter((digest(view[a:b], k) for a, b, k in zip(first.tolist(), (last + LENGTH).tolist(), lead.tolist())), np.uint64, len(first))
    return grams[chosen[first]], whole, first, last - first, lead


ROWS = "doc_id long, _row long, anchor long, whole long, span int, lead int, first array<int>"


def _anchor_rows(batches):
    """A row for each distinct context of a text, with all its places: a text that repeats itself
    gives few rows."""
    for part in slices(batches, "text"):
        raw, off = batch_bytes(part.column("text"))
        ids, row = part.column("doc_id").to_pylist(), part.column("_row").to_pylist()
        doc, rows, found = [], [], []
        for k, (a, b) in enumerate(zip(off[:-1], off[1:])):
            if b - a >= LENGTH:
                anchor, whole, first, span, lead = anchors(raw[a:b])
                order = np.argsort(whole, kind="stable")
                new = np.flatnonzero(np.concatenate(([True], (np.diff(whole[order].astype(np.int64)) != 0) | (anchor[order][1:] != anchor[order][:-1]))))
                one = order[new]
                found.append((anchor[one], whole[one], span[one], lead[one], first[order], np.diff(np.append(new, len(order)))))
                doc += [ids[k]] * len(one)
                rows += [row[k]] * len(one)
        if doc:
            anchor, whole, span, lead, first, many = (np.concatenate(c) for c in zip(*found))
            places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), pa.array(first.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(rows, pa.int64()), pa.array(signed(anchor)), pa.array(signed(whole)), pa.array(span.astype(np.int32)), pa.array(lead.astype(np.int32)), places],
                                             ["doc_id", "_row", "anchor", "whole", "span", "lead", "first"])


# --- the index --------------------------------------------------------------------------------


SEPARATOR = 256


def suffix_array(text: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by what stands before the next separator, up to ``depth`` values, then
    by position, by doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    padded = np.concatenate((text + 1, np.zeros(8, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(7):  # seven values make one key; what follows a separator doesn't count
        key = key << 9 | np.where(room >= k, padded[k : k + n], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])) | (room[order] < 7)
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    done = 7
    while done < depth:
        slot = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(slot):
            break
        at = order[slot]
        second = rank[np.minimum(at + done, n - 1)]
        both = head[slot] * np.int64(n) + second
        again = np.argsort(both, kind="stable")
        at, both = at[again], both[again]
        order[slot] = at
        fresh[slot] |= np.concatenate(([True], both[1:] != both[:-1])) | (room[at] < 2 * done)
        head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[at] = head[slot]
        done *= 2
    return order


def match_lengths(text: np.ndarray, least: int, depth: int) -> np.ndarray:
    """For each position the length of the longest match of its suffix that starts elsewhere in
    ``text`` and reaches no separator, if it is ``least`` or more; else something smaller.

    Lengths are sampled at the ends of the transform's runs. Elsewhere a suffix and its neighbour
    in the order are preceded by the same byte, so the suffix one byte earlier matches its own
    neighbour one byte longer: streaming to the right, one less with every byte since the sample.
    """
    n = len(text)
    stops = np.flatnonzero(text == SEPARATOR)
    room = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    order = suffix_array(text, room, depth)
    before = text[order - 1]  # the transform; position 0 is preceded by the last separator
    edge = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == SEPARATOR)) + 1  # run r-1 | run r
    h, inv = prefix_hash((text & 255).astype(np.uint8))

    def same(a, b, k):
        return (h[a + k] - h[a]) * inv[a] == (h[b + k] - h[b]) * inv[b]

    low_row, row = order[edge - 1], order[edge]
    reach = np.minimum(room[low_row], room[row])
    sure = reach >= least
    sure[sure] = same(low_row[sure], row[sure], least)
    a, b = low_row[sure], row[sure]
    low, high = np.full(len(a), least), np.minimum(reach[sure], depth)
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        fits = same(a, b, mid)
        low, high = np.where(open_ & fits, mid, low), np.where(open_ & ~fits, mid - 1, high)
    length = np.zeros(len(edge), np.int64)
    length[sure] = low
    best = np.zeros(n, np.int64)
    for sampled, end in ((row, order[0]), (low_row, order[-1])):
        sample = np.full(n, -1, np.int64)
        sample[sampled] = length
        sample[end] = 0
        known = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), -1))
        best = np.maximum(best, np.where(known >= 0, sample[np.maximum(known, 0)] - (np.arange(n) - known), 0))
    return best


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context which of its windows of LENGTH bytes also starts elsewhere in them."""
    size = np.array([len(c) for c in contexts])
    off = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.full(off[-1], SEPARATOR, np.int64)
    for k, c in enumerate(contexts):
        text[off[k] : off[k] + size[k]] = np.frombuffer(c, np.uint8)
    found = match_lengths(text, LENGTH, int(size.max()) + 1) >= LENGTH
    return [found[off[k] : off[k] + size[k] - LENGTH + 1] for k in range(len(contexts))]


CONTEXTS = "grp long, sub long, lead int, context binary"


def _index(batches):
    """Rows sorted by grp: indexes whole groups of contexts, several to an index, and returns (grp,
    sub, x, y): the context's window starts x to y, both included, are repeated. No window stands
    in two contexts, so an index may hold any groups together."""

    def flush(rows, parts):
        out: list[tuple[int, int, int, int]] = []
        for (g, w), found in zip(rows, repeated_windows(parts)):
            edge = np.flatnonzero(np.diff(np.concatenate(([False], found, [False])).astype(np.int8))).reshape(-1, 2)
            out += [(g, w, x, y - 1) for x, y in edge.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["grp", "sub", "x", "y"])

    rows, parts, size, last = [], [], 0, None
    for batch in batches:
        for g, w, context in zip(*(batch.column(c).to_pylist() for c in ("grp", "sub", "context"))):
            if g != last and size >= INDEX:
                yield flush(rows, parts)
                rows, parts, size = [], [], 0
            last = g
            rows.append((g, w))
            parts.append(context)
            size += len(context)
    if parts:
        yield flush(rows, parts)


def stretches(context: bytes, lead: int, width: int):
    """The context cut by intervals of ``width`` distances between a window's start and the anchor's:
    for each interval the group (a hash of the bytes that all its windows share), the first window
    and the last one, and the stretch that these cover."""
    span = len(context) - LENGTH
    for k in range(max(lead - span, 0) // width, lead // width + 1):
        low, high = k * width, min(k * width + width - 1, LENGTH - ANCHOR)
        x, y = max(lead - high, 0), min(lead - low, span)
        if x <= y:
            yield xxhash.xxh3_64_intdigest(context[max(lead - low, 0) : lead + LENGTH - high], seed=k * 128 + width), x, y, context[x : y + LENGTH]


def _stretches(width):
    def run(batches):
        for batch in batches:
            out = [(g, w, h, xxhash.xxh3_64_intdigest(cut, seed=lead - x), x, y - x, lead - x, cut)
                   for g, w, lead, context in zip(*(batch.column(c).to_pylist() for c in ("grp", "sub", "lead", "context")))
                   for h, x, y, cut in stretches(context, lead, width)]
            if out:
                c = list(zip(*out))
                unsigned = [pa.array(signed(np.array(z, np.uint64))) for z in c[2:4]]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *unsigned, *(pa.array(z, pa.int32()) for z in c[4:7]), pa.array(c[7], pa.binary())],
                                                 ["up", "up_sub", "grp", "sub", "shift", "span", "lead", "context"])
    return run


STRETCHES = "up long, up_sub long, grp long, sub long, shift int, span int, lead int, context binary"


def _contexts(batches):
    """Cuts the contexts that were chosen of each text."""
    for batch in batches:
        grp, sub, lead, cut = [], [], [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            raw = text.encode()
            for w in wanted:
                grp.append(w["anchor"])
                sub.append(w["whole"])
                lead.append(w["lead"])
                cut.append(raw[w["first"] : w["first"] + w["span"] + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(sub, pa.int64()), pa.array(lead, pa.int32()), pa.array(cut, pa.binary())], ["grp", "sub", "lead", "context"])


def repeated(contexts: DataFrame) -> DataFrame:
    """``(grp, sub, x, y)``: of contexts ``(grp, sub, lead, context)``, all different within a group, the
    window starts x to y that are repeated in their group; a window may be told twice."""
    sizes = contexts.groupBy("grp").agg(F.count("*").alias("kinds"))
    fit = contexts.join(apart(sizes.where(F.col("kinds").between(2, PART)), "grp"), "grp", "left_semi")
    found = [fit.repartition("grp").sortWithinPartitions("grp").mapInArrow(_index, "grp long, sub long, x long, y long")]
    chain, left = [], contexts.join(apart(sizes.where(F.col("kinds") > PART), "grp"), "grp", "left_semi")
    for width in INTERVALS:
        left = stage(left, "wide")
        if left.isEmpty():
            break
        cut = stage(left.select("grp", "sub", "lead", "context").mapInArrow(_stretches(width), STRETCHES), "stretches")
        # Equal stretches once, with their number: those of two contexts are repeated as they are.
        one = cut.groupBy("grp", "sub").agg(F.count("*").alias("n"), F.max("span").alias("span"), F.max("lead").alias("lead"), F.first("context").alias("context"))
        one = stage(one, "kinds_of_stretches")
        sizes = one.groupBy("grp").agg(F.count("*").alias("kinds"))
        told = one.where("n > 1").select("grp", "sub", F.lit(0).cast("long").alias("x"), F.col("span").cast("long").alias("y"))
        if width > 1:
            fit = one.join(apart(sizes.where(F.col("kinds").between(2, PART)), "grp"), "grp", "left_semi")
            told = told.unionByName(fit.select("grp", "sub", "context").repartition("grp").sortWithinPartitions("grp").mapInArrow(_index, "grp long, sub long, x long, y long"))
            left = one.join(apart(sizes.where(F.col("kinds") > PART), "grp"), "grp", "left_semi")
        chain.append(cut.select("up", "up_sub", "grp", "sub", "shift"))
        found.append(told)
    # Back from stretches to the contexts they were cut of, level by level.
    out = found.pop()
    for up in reversed(chain):
        out = out.join(up, ["grp", "sub"]).select(F.col("up").alias("grp"), F.col("up_sub").alias("sub"), (F.col("x") + F.col("shift")).alias("x"), (F.col("y") + F.col("shift")).alias("y"))
        out = out.unionByName(found.pop())
    return out


def _strip(schema_names):
    def run(batches):
        for batch in batches:
            kept, removed, spans = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("_runs").to_pylist()):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int32)
                for r in runs or ():
                    gone[r["first"]] += 1
                    gone[r["last"] + LENGTH] -= 1
                out = np.cumsum(gone[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
                spans.append(edge.reshape(-1, 2).tolist())
                removed.append(int(out.sum()))
                kept.append(raw[~out].tobytes())
            columns = {c: batch.column(c) for c in batch.schema.names} | {"kept": pa.array(kept, pa.binary()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in schema_names], schema_names)
    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept)``, one row per input row: the removed byte runs
    [start, end) of the text in UTF-8 and the bytes that are left.

    Each byte covered by a 400-byte string that also starts anywhere else is removed: in another
    row, or at another place of the same one, overlaps too; judged on the input; never across
    rows. Null and empty texts: no bytes. Texts under 400 bytes stay whole. Rows that repeat (same
    doc_id and text, too) are rows of their own, so their texts count as standing elsewhere. Empty
    table: no rows. Other columns are not read. Strings are compared by suffix order and 64-bit
    hashes of their bytes.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("_row"))
    rows = source.mapInArrow(_anchor_rows, ROWS)
    # Anchors in two places. Places are counted by share of the documents first, so that no task
    # gets all rows of a frequent anchor; the first row of a share, with its count, meets the others.
    share = rows.withColumn("share", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(SHARES)))
    within = "OVER (PARTITION BY anchor, share)"
    counted = share.selectExpr("*", f"sum(size(first)) {within} AS c", "row_number() OVER (PARTITION BY anchor, share ORDER BY whole) AS k").drop("share")
    # Rows that follow in their share stand twice for sure; they are only dealt out.
    key = F.when(F.col("k") == 1, F.col("anchor")).otherwise(F.xxhash64("doc_id", "_row", "whole", "k"))
    met = counted.withColumn("key", key).selectExpr("*", "sum(c) OVER (PARTITION BY key) AS total").where("k > 1 OR total > 1")
    shared = stage(met.select("doc_id", "_row", "anchor", "whole", "span", "lead", "first"), "shared")
    # Equal contexts once, with their number; counts are combined before the shuffle. They are equal
    # in two independent 64-bit hashes, the anchor's and the context's own.
    kinds = stage(shared.groupBy("anchor", "whole").agg(F.sum(F.size("first")).alias("n"), F.min(F.struct("doc_id", "_row", F.element_at("first", 1).alias("first"), "span", "lead")).alias("at")), "kinds")
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    wanted = kinds.join(apart(mixed, "anchor"), "anchor").groupBy("at.doc_id", "at._row").agg(F.collect_list(F.struct("whole", "anchor", "at.first", "at.span", "at.lead")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), "wanted")
    cut = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r"))).select("text", "wanted")
    contexts = stage(cut.mapInArrow(_contexts, CONTEXTS), "contexts")
    hits = repeated(contexts)
    # Runs of repeated window starts: all of a context that stands twice, else what the index found.
    twice = kinds.where("n > 1").select("anchor", "whole", F.lit(0).cast("long").alias("x"), F.col("at.span").cast("long").alias("y"))
    told = stage(twice.unionByName(hits.select(F.col("grp").alias("anchor"), F.col("sub").alias("whole"), "x", "y")), "told")
    marked = shared.join(told, ["anchor", "whole"]).select("doc_id", "_row", "x", "y", F.explode("first").alias("p"))
    marked = marked.select("doc_id", "_row", F.struct((F.col("p") + F.col("x")).alias("first"), (F.col("p") + F.col("y")).alias("last")).alias("r"))
    runs = marked.groupBy("doc_id", "_row").agg(F.collect_set("r").alias("_runs")).select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), "_runs")
    joined = source.join(runs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left")
    out = joined.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text", "_runs")
    return out.mapInArrow(_strip(["doc_id", "n_bytes", "n_removed", "spans", "kept"]), "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """The same by counting all windows: for tests."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for s in range(len(r) - LENGTH + 1):
            w = r[s : s + LENGTH]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - LENGTH + 1):
            if seen[r[s : s + LENGTH]] > 1:
                gone[s : s + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
