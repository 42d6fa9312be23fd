"""N-gram Jaccard join through count-vector R-trees (operator 1).

A document's word shingles are hashed into groups; the groups' sizes are its point. Two documents
that link have equal shingle subsets in most groups, so a bounded number of group subsets of each
document (see :func:`_signatures`) is sure to contain a common one: these are the blocks, which only
say which points share a tree. Each block is packed into an R-tree (:class:`Tree`): boxes over points, split
where they are widest, inner boxes over these. The tree is joined with itself from the root down; pairs
of boxes, then of points, are kept only where the summed coordinate minima can reach the overlap
that Jaccard 0.8 needs. The surviving pairs, and no others, are verified on whole texts.

No group of copies is expanded into pairs: equal shingle sets are one point, equal blocks one block,
and in blocks of several leaves the first rounds take spanning pairs only (each point with the best
one of its leaf, and one pair across each inner box). The last round joins across components only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernel import mix, shingle_sets, signed, slices
from .store import apart, columns, stage, table, text_key, unused

U = np.uint64
#: Members of a block up to which one tree holds it; larger ones are dealt out in parts.
BLOCK = 2048
#: Rounds of spanning pairs before all pairs that are left, each over its own share of the blocks.
ROUNDS, SHARE_OF_BLOCKS = 2, 4
#: Points of a leaf; coordinates of a point at most (groups beyond are folded together).
LEAF, COORDINATES = 32, 1024
#: Least keys of a node that tell whether a pair stands in an earlier block.
EARLIER = 8
#: Partners of one text that one task verifies.
PARTNERS = 256
#: Set hashes that a worker remembers, to describe equal sets once.
REMEMBERED = 100_000


def links(p: np.ndarray | int, q: np.ndarray | int, overlap: np.ndarray | int) -> np.ndarray | bool:
    """100 * |intersection| >= 80 * |union|, from set sizes."""
    return 9 * overlap >= 4 * (p + q)


def _classes(n: int) -> list[tuple[int, int]]:
    """The size classes [4**c, 4**(c+1)) that a set of ``n`` shingles takes part in, with the
    number of groups of each: its own, and the next if a partner (up to 5n/4) can be in it."""
    c = 0
    while 4 ** (c + 1) <= n:
        c += 1
    return [(k, 5 * 4**k // 4 + 2) for k in ([c, c + 1] if 5 * n >= 4 * 4 ** (c + 1) else [c])]


def _signatures(s: np.ndarray, cls: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Block keys and the point (group counts) of a shingle set in one size class.

    Sets p, q that link differ in at most (p + q) / 9 shingles, so they agree on all but d of the
    groups, where d = (n + 5n/4) / 9 bounds this for any partner. Each document orders its group
    subsets by one global order (largest first, then by hash); the first d + 1 of two documents
    that agree on all but d must have a common one.
    """
    n = len(s)
    d = (n + 5 * n // 4) // 9
    g = (mix(s, 11 + cls) % U(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    count = np.bincount(g, minlength=groups)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s, 12)[order], dtype=np.uint64)))
    edge = np.concatenate(([0], np.cumsum(count)))
    subset = total[edge[1:]] - total[edge[:-1]]
    key = mix(subset ^ mix(np.arange(groups, dtype=np.uint64), 13 + cls), 14)
    first = np.lexsort((key, -count))[: d + 1]
    if groups > COORDINATES:
        count = np.bincount(np.arange(groups) % COORDINATES, count, COORDINATES).astype(np.int64)
    return key[first], count


def _describe(batches):
    """A row for each class of a document: (doc_id, _row, n, s1, s2, cls, keys, counts); one with cls -1
    where there are no words or no doc_id, or where this worker has just described an equal set."""
    seen: set[tuple[int, int, int]] = set()
    for part in slices(batches, "text"):
        sets = shingle_sets(part.column("text"))
        ids, row = part.column("doc_id").to_pylist(), part.column("_row").to_pylist()
        out: list[tuple] = []
        for i, r, s in zip(ids, row, sets):
            if not len(s):
                out.append((i, r, 0, 0, 0, -1, None, None))
                continue
            s1, s2 = (int(signed(x)[0]) for x in (mix(s, 21).sum(keepdims=True), np.bitwise_xor.reduce(mix(s, 22), keepdims=True)))
            if i is None or (len(s), s1, s2) in seen:
                out.append((i, r, len(s), s1, s2, -1, None, None))
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add((len(s), s1, s2))
            for cls, groups in _classes(len(s)):
                keys, count = _signatures(s, cls, groups)
                out.append((i, r, len(s), s1, s2, cls, signed(keys), np.minimum(count, 255).astype(np.uint8).tobytes()))
        columns = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()))],
                                         ["doc_id", "_row", "n", "s1", "s2", "cls", "keys", "counts"])


DESCRIBED = "doc_id long, _row long, n long, s1 long, s2 long, cls int, keys array<long>, counts binary"


def overlap_bound(a: np.ndarray, b: np.ndarray, na, nb) -> np.ndarray:
    """Summed coordinate minima, an upper bound of the overlap. Counts are stored up to 255; what a
    point holds beyond that is added to the bound, so it stays an upper bound."""
    beyond = np.minimum(na - a.sum(-1, dtype=np.int64), nb - b.sum(-1, dtype=np.int64))
    return np.minimum(a, b).sum(-1, dtype=np.int64) + beyond


def sizes_fit(p, q):
    return 5 * np.minimum(p, q) >= 4 * np.maximum(p, q)


class Tree:
    """An R-tree over count vectors, packed by halving along the widest coordinate.

    Node 0 is the root; ``first``/``last``: a node's stretch of ``order``; ``left``/``right``: its children (-1:
    a leaf). Of a box, the corner of largest counts (``high``), the least and largest set size, what
    sizes hold beyond the counts, the least and largest component and side.
    """

    def __init__(self, points: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray):
        self.points, self.n, self.comp, self.side = points, n, comp, side
        self.order = np.arange(len(n))
        first, last, left, right = [0], [len(n)], [-1], [-1]
        k = 0
        while k < len(first):
            a, b = first[k], last[k]
            if b - a > LEAF:
                part = self.order[a:b]
                at = points[part]
                spread = at.max(0).astype(np.int64) - at.min(0)
                by, half = at[:, spread.argmax()].astype(np.int64), (b - a) // 2
                if spread.max() * len(spread) < n[part].max() - n[part].min():
                    by = n[part]
                self.order[a:b] = part[np.argpartition(by, half)]
                left[k], right[k] = len(first), len(first) + 1
                first += [a, a + half]
                last += [a + half, b]
                left += [-1, -1]
                right += [-1, -1]
            k += 1
        self.first, self.last, self.left, self.right = map(np.array, (first, last, left, right))
        spare = n - points.sum(1, dtype=np.int64)
        pick = [self.order[a:b] for a, b in zip(first, last)]
        self.high = np.array([points[x].max(0) for x in pick])
        self.spare = np.array([spare[x].max() for x in pick])
        self.n_low, self.n_high = np.array([(n[x].min(), n[x].max()) for x in pick]).T
        self.c_low, self.c_high = np.array([(comp[x].min(), comp[x].max()) for x in pick]).T
        self.s_low, self.s_high = np.array([(side[x].min(), side[x].max()) for x in pick]).T

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether boxes a and b (arrays of nodes) can hold a pair that links, of two components and,
        if there are two sides, one of each."""
        ok = 5 * np.minimum(self.n_high[a], self.n_high[b]) >= 4 * np.maximum(self.n_low[a], self.n_low[b])
        ok &= (self.c_low[a] != self.c_high[b]) | (self.c_high[a] != self.c_low[b])
        if self.s_low[0] != self.s_high[0]:
            ok &= (self.s_low[a] != self.s_high[b]) | (self.s_high[a] != self.s_low[b])
        some = np.flatnonzero(ok)
        for k in range(0, len(some), 4096):
            x, y = a[some[k : k + 4096]], b[some[k : k + 4096]]
            top = np.minimum(self.high[x], self.high[y]).sum(1, dtype=np.int64) + np.minimum(self.spare[x], self.spare[y])
            ok[some[k : k + 4096]] = links(self.n_low[x], self.n_low[y], top)
        return ok

    def leaf_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of leaves (a leaf with itself, too) that the descent of all pairs of boxes reaches."""
        a, b, done = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(a):
            ok = self.may_link(a, b)
            a, b = a[ok], b[ok]
            leaf_a, leaf_b = self.left[a] < 0, self.left[b] < 0
            done.append((a[leaf_a & leaf_b], b[leaf_a & leaf_b]))
            inner = ~(leaf_a & leaf_b)
            a, b = a[inner], b[inner]
            kids = lambda x, k: np.where(self.left[x] < 0, x, (self.left, self.right)[k][x])
            pairs = np.unique(np.concatenate([np.sort(np.stack((kids(a, i), kids(b, j)), 1), 1) for i in (0, 1) for j in (0, 1)]), axis=0)
            a, b = pairs[:, 0], pairs[:, 1]
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (a, b)

    def leaf(self, k: int) -> np.ndarray:
        return self.order[self.first[k] : self.last[k]]

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For points x against y the Jaccard similarity that their bound allows, 0 where they can't
        link or needn't (one component, or one side of two)."""
        p, q = self.n[x][:, None], self.n[y][None, :]
        bound = np.empty((len(x), len(y)), np.int64)
        for k in range(0, len(x), 8):
            bound[k : k + 8] = overlap_bound(self.points[x[k : k + 8]][:, None, :], self.points[y][None, :, :], p[k : k + 8], q)
        ok = links(p, q, bound) & sizes_fit(p, q) & (self.comp[x][:, None] != self.comp[y][None, :])
        if self.s_low[0] != self.s_high[0]:
            ok &= self.side[x][:, None] != self.side[y][None, :]
        return np.where(ok, bound / (p + q - bound), 0.0)

    def join(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of points whose bound lets them link."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for u, v in zip(*(z.tolist() for z in self.leaf_pairs())):
            x, y = self.leaf(u), self.leaf(v)
            ok = self.alike(x, y) > 0
            i, j = np.nonzero(np.triu(ok, 1) if u == v else ok)
            left.append(x[i])
            right.append(y[j])
        return np.concatenate(left), np.concatenate(right)

    def span(self) -> tuple[np.ndarray, np.ndarray]:
        """Spanning pairs, about as many as points: of each point with the one of its leaf that its bound
        favours, and across each inner node one such pair of its children's first leaves."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(len(self.first)):
            x = self.leaf(k) if self.left[k] < 0 else self.order[self.first[self.left[k]] :][:LEAF // 2]
            y = x if self.left[k] < 0 else self.order[self.first[self.right[k]] :][:LEAF // 2]
            alike = self.alike(x, y)
            if self.left[k] < 0:
                np.fill_diagonal(alike, 0)
                best = alike.argmax(1)
                some = np.flatnonzero(alike[np.arange(len(x)), best] > 0)
                left.append(x[some])
                right.append(y[best[some]])
            elif alike.max() > 0:
                i, j = np.unravel_index(alike.argmax(), alike.shape)
                left.append(x[i : i + 1])
                right.append(y[j : j + 1])
        return np.concatenate(left), np.concatenate(right)


def single_leaves(block: np.ndarray, points: np.ndarray, n: np.ndarray, comp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The joins of many blocks of one leaf each (``block``: their numbers, in order) at once; a pair of
    nodes that stands in several is looked at once."""
    left, right = [], []
    for d in range(1, LEAF):
        i = np.flatnonzero(block[:-d] == block[d:]) if d < len(block) else np.zeros(0, np.int64)
        i = i[(comp[i] != comp[i + d]) & sizes_fit(n[i], n[i + d])]
        left.append(i)
        right.append(i + d)
    i, j = np.concatenate(left), np.concatenate(right)
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])) if len(order) else np.zeros(0, bool)
    i, j = i[order][new], j[order][new]
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 4096):
        x, y = i[k : k + 4096], j[k : k + 4096]
        keep[k : k + 4096] = links(n[x], n[y], overlap_bound(points[x], points[y], n[x], n[y]))
    return i[keep], j[keep]


def told_earlier(key: int, first: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs in the block ``key``: whether the nodes' least keys (``first``) show a lesser block that
    holds both and tells the pair there. In the least block of all that hold both, none does."""
    out = np.zeros(len(x), bool)
    for k in range(0, len(x), 4096):
        p, q = first[x[k : k + 4096]], first[y[k : k + 4096]]
        out[k : k + 4096] = ((p[:, :, None] == q[:, None, :]) & (p < key)[:, :, None]).any((1, 2))
    return out


#: Rows of blocks that are joined together, about.
ROWS_AT_ONCE = 1 << 13


def _block_pairs(spanning: bool):
    """The tree joins of all blocks of a partition sorted by (cls, key, i, j)."""

    def joined(t: pa.Table):
        node, n, comp, part = (t.column(c).to_numpy() for c in ("node", "n", "comp", "part"))
        i, j, key = (t.column(c).to_numpy() for c in ("i", "j", "key"))
        counts = t.column("counts").to_pylist()
        points = np.frombuffer(b"".join(counts), np.uint8).reshape(len(counts), -1)
        first = np.full((len(key), EARLIER), np.iinfo(np.int64).max)
        for k, f in enumerate(t.column("earlier").to_pylist()):
            if f:
                first[k, : len(f)] = f
        edge = np.append(np.append(0, np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1), len(key))
        size = np.diff(edge)
        small = np.repeat(size <= LEAF, size) & (i == j)
        at = np.flatnonzero(small)
        a, b = single_leaves(np.repeat(np.arange(len(size)), size)[at], points[at], n[at], comp[at], node[at])
        left, right = [node[at[a]]], [node[at[b]]]
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if not small[x]:
                tree = Tree(points[x:y], n[x:y], comp[x:y], part[x:y] if i[x] != j[x] else np.zeros(y - x, np.int64))
                a, b = tree.span() if spanning else tree.join()
                if not spanning:
                    new = ~told_earlier(key[x], first[x:y], a, b)
                    a, b = a[new], b[new]
                left.append(node[x:y][a])
                right.append(node[x:y][b])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        for rows in _whole_blocks(batches):
            yield joined(rows)

    return run


def _whole_blocks(batches):
    """Tables of one class that hold whole blocks, about ROWS_AT_ONCE rows or one block each."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cls, key, i, j = (batch.column(c).to_numpy() for c in ("cls", "key", "i", "j"))
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(cls) != 0)) + 1).tolist(), batch.num_rows]
        start = 0
        for x in cuts[:-1]:
            now = (cls[x], key[x], i[x], j[x])
            if last is not None and now != last and (now[0] != last[0] or size + x - start >= ROWS_AT_ONCE):
                if x > start:
                    held.append(batch.slice(start, x - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, x
            last = now
        held.append(batch.slice(start))
        size += batch.num_rows - start
    if held:
        yield pa.Table.from_batches(held)


def _verified(batches):
    """Rows sorted by (a, share, b), the first of each (a, share) with a's own text and no b, the others
    with b's: the pairs whose whole texts link. A set is made once a row."""
    last, own = None, None
    for part in slices(batches, "text"):
        a, b = [], []
        for x, share, y, s in zip(*(part.column(c).to_pylist() for c in ("a", "share", "b")), shingle_sets(part.column("text"))):
            if y is None:
                last, own = (x, share), s
                continue
            if last != (x, share):
                raise AssertionError("a pair came before its first text")
            if sizes_fit(len(own), len(s)) and links(len(own), len(s), len(np.intersect1d(own, s, assume_unique=True))):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, on their whole texts. A node with very many partners is
    shared out, so no task gets them all, and its text goes to each share once, not to each pair."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "b")
    heads = many.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"))
    rows = heads.withColumn("node", F.col("a")).unionByName(dealt.withColumn("node", F.col("b"))).join(texts, "node").select("a", "share", "b", "text")
    return rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first()).mapInArrow(_verified, "a long, b long")


def _dealt(known: DataFrame, points: DataFrame, spanning: bool) -> DataFrame:
    """Rows of blocks, keyed by (cls, key, i, j): a block of up to ``BLOCK`` members is one tree. Of
    larger ones, spanning rounds take each part by itself (parts differ from block to block). The last round lets
    every part meet those of the members outside the block's largest component: what is inside that
    needs no pairs, so a group of copies costs its size times the number of strangers, by parts."""
    of_comp = known.groupBy("key", "comp").agg(F.count("*").alias("m"))
    most = of_comp.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("all"), F.count("*").alias("comps")).where("comps > 1").select("key", "most", "all")
    most = apart(most, "key")
    rows = known.join(most, "key")
    parts = lambda x: F.ceil(x / BLOCK).cast("int")
    dice = F.xxhash64("node", "key")
    if spanning:
        rows = rows.withColumn("part", F.pmod(dice, parts(F.col("all"))).cast("int")).withColumns({"i": F.col("part"), "j": F.col("part")})
    else:
        major, whole = F.col("comp") == F.col("most.comp"), F.col("all") <= BLOCK
        pm, po = parts(F.col("most.m")), parts(F.col("all") - F.col("most.m"))
        rows = rows.withColumns({"pm": pm, "po": po, "major": major, "whole": whole})
        rows = rows.withColumn("part", F.when(F.col("whole"), F.lit(0)).when(F.col("major"), F.pmod(dice, F.col("pm"))).otherwise(F.col("pm") + F.pmod(dice, F.col("po"))).cast("int"))
        others = F.when(F.col("whole"), F.array(F.lit(0))).when(F.col("major"), F.sequence(F.col("pm"), F.col("pm") + F.col("po") - 1)).otherwise(F.sequence(F.lit(0), F.col("pm") + F.col("po") - 1))
        rows = rows.withColumn("other", F.explode(others)).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    # A pair of the larger blocks is told in one of them, as far as a few of its nodes' keys show.
    earlier = known.where(F.lit(not spanning) & (F.col("c") > LEAF)).join(most, "key", "left_semi").groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, EARLIER).alias("earlier"))
    rows = rows.join(points, ["node", "cls"]).join(earlier, "node", "left").select("cls", "key", "i", "j", "part", "node", "n", "comp", "counts", "earlier")
    return rows.repartition("key", "i", "j").sortWithinPartitions("cls", "key", "i", "j")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, _row, n_shingles, component_id)`` for every distinct (doc_id, text) row.

    A document's set: its distinct 5-word shingles over words ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased; with fewer words the whole sequence as one; without words, or null: empty and
    linked with nothing (its own component). Two link at Jaccard 0.8 or more; the component is the
    smallest doc_id reachable. Equal sets always share a component. Rows equal in doc_id and text
    count as one; a null doc_id is linked with nothing (component null). ``_row`` tells apart
    different texts under one doc_id (each has its own component). Empty table: no rows. Other
    columns are not read. Sets are told apart by 128 bits and their size, as nodes by 64 bits.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("_row"))
    node = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("n", "s1", "s2")).otherwise(F.xxhash64("doc_id", "_row"))
    described = stage(source.mapInArrow(_describe, DESCRIBED), "described").withColumn("node", node)

    # Blocks of two nodes or more: minima are combined before the shuffle, and the join's side of
    # many rows can be split, so a hot block is never gathered.
    rows = described.where("cls >= 0").select(F.explode("keys").alias("key"), "node", "cls")
    two = rows.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
    shared = stage(apart(rows.join(apart(two, "key"), "key", "left_semi"), "key").distinct(), "shared")
    # Blocks of equal members are one block.
    alike = shared.groupBy("key", "cls").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kept = alike.groupBy("cls", "c", "x", "y").agg(F.min("key").alias("key")).select("key", "cls", "c")
    blocks = stage(shared.join(kept, ["key", "cls"]), "blocks")

    # Whole texts and points of the block members only: the one time that texts are shuffled.
    inside = blocks.select("node").distinct()
    of_blocks = described.where("cls >= 0").join(inside, "node", "left_semi")
    points = stage(of_blocks.groupBy("node", "cls").agg(F.min("n").alias("n"), F.min("counts").alias("counts")), "points")
    least = of_blocks.groupBy("node").agg(F.min(F.struct("doc_id", "_row")).alias("at")).select("node", "at.doc_id", "at._row")
    texts = stage(source.join(least, ["doc_id", "_row"]).select("node", "text").dropDuplicates(["node"]), "texts")

    linked, comp, known = None, None, blocks
    for round_ in range(ROUNDS + 1):
        spanning = round_ < ROUNDS
        if comp is not None:
            known = stage(known.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"), "known")
        else:
            known = known.withColumn("comp", F.col("node"))
        tried = known.where((F.col("c") > LEAF) & (F.pmod(F.xxhash64("key"), F.lit(SHARE_OF_BLOCKS)) == round_)) if spanning else known
        pairs = stage(_dealt(tried, points, spanning).mapInArrow(_block_pairs(spanning), "a long, b long").distinct(), "pairs")
        if pairs.isEmpty():
            continue
        more = stage(_verify(pairs, texts), "links")
        if more.isEmpty():
            continue
        linked = more if linked is None else linked.unionByName(more)
        comp = components(linked)

    # Back to documents.
    whose = described.select("doc_id", "_row", "n", "node").distinct()
    if comp is not None:
        whose = whose.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        whose = whose.withColumn("component", F.col("node"))
    smallest = whose.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return whose.join(smallest, "component").select("doc_id", "_row", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the one whose doc_id is the component's, with all its
    columns, whatever their names. Rows equal in doc_id and text are one document: of those that
    differ elsewhere the one of least hash stays. Rows without doc_id stay, equal texts once."""
    key, d, r = unused(docs, "key", "d", "r")
    found = jaccard_components(docs).where("component_id = doc_id OR doc_id IS NULL").select(F.col("doc_id").alias(d), F.col("_row").alias(r)).distinct()
    kept = docs.withColumn(key, text_key()).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(r)), "left_semi")
    own = columns(docs.columns)
    one = kept.groupBy("doc_id", key).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias(d))
    return one.select(f"{d}.*")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
