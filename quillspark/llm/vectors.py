"""Nearest-vector searches: collision-counting hashing (operator 3) and a pivot-distance index
(operator 4). Both turn a largest inner product into a least distance by one more coordinate:
with R the largest norm, x' = (x, sqrt(R^2 - |x|^2)) and q' = (q, 0), |q' - x'|^2 = |q|^2 + R^2 - 2 q.x.

Equal vectors are one unit with its smallest ids. Units lie in cells of bounded size, each indexed
once where it is read. A query first searches the cell it lies in itself; the distance of the
worst of its best there then says which other cells it goes to, and how far it looks in them. Queries
stream past a cell's index, so neither side is gathered.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stage, table

#: Units of a cell, about (operator 3, operator 4), and queries that one reading of a cell serves.
BLOCK, CELL, QUERIES = 16384, 2048, 8192


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with a non-null vector of finite components (double), as (vec_id, v, norm2)."""
    v = F.col(column).cast("array<double>")
    fine = F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    df = vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return df.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _units(data: DataFrame, is_query: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors ``(uid, v, ids, asked)`` with their ``keep`` smallest ids, more of which no result can
    hold, and the queries ``(query_id, uid)``. Ranks are cut before the shuffle, so the copies of a
    frequent vector don't meet."""
    data = data.select("vec_id", "v", F.xxhash64("v").alias("uid"), F.expr(is_query).alias("asked"))
    asks = data.where("asked").select(F.col("vec_id").alias("query_id"), "uid").distinct()
    first = lambda c, n: data.where(c).withColumn("r", F.dense_rank().over(Window.partitionBy("uid").orderBy("vec_id"))).where(F.col("r") <= n)
    least = first(F.lit(True), keep).groupBy("uid").agg(F.min("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    asked = asks.select("uid").distinct().withColumn("asked", F.lit(True))
    return least.join(asked, "uid", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), asks


def merge_top(found: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """Lists of all cells to ranks: the best of each unit, given to its queries, without their own ids."""
    order = [F.col("score").desc(), F.col("vec_id")]
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("uid").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
    each = best.join(asks, "uid").where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _rows(column, dim: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _stream(keep: int, dim: int, kind, build):
    """Rows sorted by (cell, share, kind): the units of a cell (kind 0), then queries (kind 1) with the score
    that is sure already. ``build(cell, x, least ids)`` indexes the units; its ``search(q, sure)`` returns the
    scores and places of the ``keep`` best. Returns (uid, vec_id, score): ``keep`` ids of each query."""
    typed = pa.int64() if kind is np.int64 else pa.float64()

    def run(batches):
        last, parts, index, names = None, [], None, []
        for batch in batches:
            cell, share, what = (batch.column(c).to_numpy() for c in ("cell", "share", "kind"))
            turn = np.flatnonzero((np.diff(cell) != 0) | (np.diff(share) != 0) | (np.diff(what) != 0)) + 1
            out: list[tuple[int, int, float]] = []
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), batch.num_rows]):
                if b == a:
                    continue
                if (cell[a], share[a]) != last:
                    last, parts, index = (cell[a], share[a]), [], None
                piece = batch.slice(a, b - a)
                if not what[a]:
                    parts.append(piece)
                    continue
                if not parts:
                    continue
                if index is None:
                    names = [i for p in parts for i in p.column("ids").to_pylist()]
                    index = build(int(cell[a]), np.concatenate([_rows(p.column("v"), dim, kind) for p in parts]), np.array([i[0] for i in names]))
                for uid, q, sure in zip(piece.column("uid").to_pylist(), _rows(piece.column("v"), dim, kind), piece.column("sure").to_pylist()):
                    scores, places = index.search(q, -np.inf if sure is None else sure)
                    told = sorted((-s, i) for s, p in zip(scores.tolist(), places.tolist()) for i in names[p])[:keep]
                    out += [(uid, i, -s) for s, i in told]
            c = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], typed)], ["uid", "vec_id", "score"])

    return run


def _search(units: DataFrame, queries: DataFrame, run, score: str) -> DataFrame:
    """Units (cell, uid, v, ids) meet queries (cell, uid, v, sure) of their cells. A cell asked by very many
    queries is read several times, each time for a share of them."""
    shares = queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
    left = units.join(shares, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "uid", "v", "ids", F.lit(None).cast("double").alias("sure"))
    right = queries.join(shares, "cell").select("cell", F.pmod(F.xxhash64("uid"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"), "uid", "v", F.lit(None).cast("array<long>").alias("ids"), F.col("sure").cast("double").alias("sure"))
    both = left.unionByName(right).repartition("cell", "share").sortWithinPartitions("cell", "share", "kind", "uid")
    return both.mapInArrow(run, f"uid long, vec_id long, score {score}")


def _sure(found: DataFrame, keep: int) -> DataFrame:
    """``(uid, sure)``: the least score of a full list of the first search."""
    return found.groupBy("uid").agg(F.min("score").alias("sure"), F.count("*").alias("n")).where(F.col("n") >= keep).select("uid", "sure")


def _by_length(vectors: DataFrame, one) -> DataFrame | None:
    """Vectors of different lengths have no inner product: each length is searched by itself."""
    out = None
    for row in vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("norm2").alias("norm2")).collect():
        found = one(vectors.where(F.size("v") == row.dim), row.dim, row.n, float(np.sqrt(row.norm2)))
        out = found if out is None else out.unionByName(found)
    return out


# --- operator 3 -------------------------------------------------------------------------------

#: The share of the projections in which a vector must collide to be verified; the share in which the
#: farthest vector that is wanted is expected to; growth of the windows.
COLLIDE, EXPECTED, GROW = 0.72, 0.78, 1.08


class Windows:
    """Sorted arrays of one cell's values in single random projections, all orthogonal to each other
    (as many as there are coordinates, so that together they lose nothing).

    Around a query's own values windows open; a vector in the windows of COLLIDE of the projections
    collides and is verified on the original vectors. A vector at distance d lies in a window of half
    width w in a share erf(w / d) of the projections, so windows of ``reach`` * d find what lies up to d.
    With nothing sure yet windows grow by virtual rehashing, until the worst of the ``keep`` best
    verified lies within what they reach; else they open once, as far as what is sure says.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, radius: float, keep: int, seed: int = 17):
        n, dim = x.shape
        self.x, self.ids, self.radius, self.keep, self.looked = x, ids, radius, keep, 0
        m = dim + 1
        self.a = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, m)))[0] * np.sqrt(m)
        extra = np.sqrt(np.maximum(radius**2 - (x * x).sum(1), 0))
        values = (np.concatenate((x, extra[:, None]), 1) @ self.a).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.order, 1)
        self.least = int(np.ceil(COLLIDE * m))
        self.reach = NormalDist().inv_cdf((1 + EXPECTED) / 2)

    def colliding(self, at: np.ndarray, width: float) -> np.ndarray:
        m, n = self.values.shape
        low = [int(v.searchsorted(c - width)) for v, c in zip(self.values, at)]
        high = [int(v.searchsorted(c + width, "right")) for v, c in zip(self.values, at)]
        if sum(high) - sum(low) <= m * n // 2:
            hits = np.bincount(np.concatenate([o[s:e] for o, s, e in zip(self.order, low, high)]), minlength=n)
            return np.flatnonzero(hits >= self.least)
        misses = np.bincount(np.concatenate([x for o, s, e in zip(self.order, low, high) for x in (o[:s], o[e:])]), minlength=n)
        return np.flatnonzero(misses <= m - self.least)

    def search(self, q: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
        norm = float(np.sqrt((q * q).sum()))
        # An inner product knows no length of the query: it is brought to the vectors' own.
        at = np.append(q * (self.radius / norm), 0) @ self.a
        away = lambda s: np.sqrt(max(2 * self.radius * (self.radius - s / norm), 0)) + 1e-12 * self.radius
        once = sure > -np.inf
        width = self.reach * away(sure) if once else 0.7 * self.radius
        while True:
            near = self.colliding(at, width)
            scores = self.x[near] @ q
            best = top(scores, self.ids[near], self.keep)
            if once or len(near) == len(self.x) or len(best) == self.keep and self.reach * away(scores[best[-1]]) <= width:
                self.looked += len(near)
                return scores[best], near[best]
            width *= GROW


def approximate_neighbours(vectors: DataFrame, is_query: str, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row the ``k`` vectors of largest inner
    product that collision counting finds (recall against brute force is tested to be over 0.9),
    nearest first, ties to the smaller vec_id; scores are exact, in double precision.

    Rows whose vector is null, empty, zero or has null or non-finite components take no part; of
    rows equal in vec_id and vector, one counts; different vectors of one vec_id are candidates
    each, of other queries only, and as queries share the ``k`` ranks of their vec_id. Fewer
    candidates than ``k``: all of them that are found. Vectors of different lengths are no
    candidates of each other. Empty table: no rows. Other columns are not read. Every vector is in the
    index: each block of them has its own projections' sorted arrays, made once.
    """
    spark = vectors.sparkSession
    data = stage(usable(vectors).where("norm2 > 0").distinct(), "vectors")

    def one(data: DataFrame, dim: int, n: int, radius: float) -> DataFrame:
        blocks = max(1, -(-n // BLOCK))
        units, asks = _units(data, is_query, k + 1)
        units = stage(units.withColumn("cell", F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(blocks)).cast("long")), "units")
        run = _stream(k + 1, dim, np.float64, lambda cell, x, ids: Windows(x, ids, radius, k + 1))
        home = units.where("asked").select("cell", "uid", "v", F.lit(None).cast("double").alias("sure"))
        found = stage(_search(units, home, run, "double"), "found")
        if blocks > 1:
            away = home.drop("sure").join(_sure(found, k + 1), "uid", "left").withColumn("home", F.col("cell")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).where("cell <> home")
            found = found.unionByName(_search(units, away, run, "double"))
        return merge_top(found, asks, k)

    return _by_length(data, one) or spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


# --- operator 4 -------------------------------------------------------------------------------

#: Pivots (a bounded sample of the units, of least hash), annuli of one pivot at most, first step of an annulus.
PIVOTS, ANNULI, STEP = 64, 64, 16


class Annulus:
    """The units of one pivot in one range of distances, sorted by distance.

    Around the query's own distance to the pivot the annulus expands both ways, nearest first, in growing
    steps; |d(q, pivot) - d(x, pivot)| never exceeds d(q, x), so a side is done once its next unit lies
    beyond the distance of the worst of the ``keep`` best. Bounds leave room for rounding, scores are
    exact integers.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, pivot: np.ndarray, r2: float, keep: int):
        far = np.sqrt(_distance2(x, pivot[None, :], r2)[:, 0])
        order = np.argsort(far, kind="stable")
        self.x, self.ids, self.far = x[order], ids[order], far[order]
        self.place, self.pivot, self.r2, self.keep, self.looked = order, pivot, r2, keep, 0
        self.most = float(np.abs(x).max(initial=0))

    def search(self, q: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
        qf = q.astype(np.float64)
        q2 = float((qf**2).sum())
        # Doubles add up integer products exactly, and much faster, as long as no sum can pass 2**53.
        fits = len(q) * self.most * float(np.abs(qf).max(initial=0)) < 2.0**53
        slack = 1e-6 * np.sqrt(q2 + self.r2) + 1e-6
        to = float(np.sqrt(((self.pivot - np.append(qf, 0)) ** 2).sum()))
        reach = lambda s: np.sqrt(max(q2 + self.r2 - 2.0 * s, 0)) + slack if s > -np.inf else np.inf
        far, n, bound, step = self.far, len(self.far), reach(sure), STEP
        low = high = int(far.searchsorted(to))
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            a = max(low - step, int(far.searchsorted(to - bound))) if low else 0
            b = min(high + step, int(far.searchsorted(to + bound, "right"))) if high < n else n
            a, b = min(a, low), max(b, high)
            if a == low and b == high:
                return scores, self.place[places]
            some = np.concatenate((np.arange(a, low), np.arange(high, b)))
            got = (self.x[some].astype(np.float64) @ qf).astype(np.int64) if fits else self.x[some] @ q
            self.looked += len(some)
            places, scores = np.concatenate((places, some)), np.concatenate((scores, got))
            best = top(scores, self.ids[places], self.keep)
            places, scores = places[best], scores[best]
            if len(places) == self.keep:
                bound = min(bound, reach(float(scores[-1])))
            low, high, step = a, b, 2 * step


def _distance2(x: np.ndarray, pivots: np.ndarray, r2: float, extend: bool = True) -> np.ndarray:
    """Squared distances of vectors, brought to norm sqrt(r2) by one more coordinate (queries: by 0)."""
    x = x.astype(np.float64)
    size = (x * x).sum(1)
    last = np.sqrt(np.maximum(r2 - size, 0)) if extend else np.zeros(len(x))
    e = np.concatenate((x, last[:, None]), 1)
    return np.maximum((e * e).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * e @ pivots.T, 0)


def _nearest_pivot(pivots: np.ndarray, r2: float, dim: int):
    def run(batches):
        for batch in batches:
            d2 = _distance2(_rows(batch.column("v"), dim, np.int64), pivots, r2)
            near = d2.argmin(1)
            columns = [*batch.columns, pa.array(near.astype(np.int64)), pa.array(np.sqrt(d2[np.arange(len(near)), near]))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "pivot", "far"])
    return run


def reachable(q: np.ndarray, sure: np.ndarray, pivots: np.ndarray, r2: float, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each query (a row) can have one of its best in each annulus (a column): its distance to the
    pivot, the annulus's ends and the plane half way to the query's nearest pivot bound the distance."""
    d = np.sqrt(_distance2(q, pivots, r2, extend=False))
    q2 = (q.astype(np.float64) ** 2).sum(1)
    bound = np.where(sure > -np.inf, np.sqrt(np.maximum(q2 + r2 - 2 * np.where(sure > -np.inf, sure, 0), 0)) + 1e-6 * np.sqrt(q2 + r2) + 1e-6, np.inf)
    own = d[:, pivot]
    least = np.maximum(np.maximum(low[None, :] - own, own - high[None, :]), (own - d.min(1)[:, None]) / 2)
    return least <= bound[:, None]


def _routes(pivots, r2, dim, annuli):
    pivot, ring, low, high, parts = annuli

    def run(batches):
        for batch in batches:
            q = _rows(batch.column("v"), dim, np.int64)
            sure = batch.column("sure").to_numpy(zero_copy_only=False).astype(float)
            ok = reachable(q, np.where(np.isnan(sure), -np.inf, sure), pivots, r2, pivot, low, high)
            i, j = np.nonzero(ok)
            i, j = np.repeat(i, parts[j]), np.repeat(j, parts[j])
            part = np.arange(len(j)) - np.flatnonzero(np.append(True, (np.diff(j) != 0) | (np.diff(i) != 0)))[np.cumsum(np.append(True, (np.diff(j) != 0) | (np.diff(i) != 0))) - 1] if len(j) else j
            cell = cell_number(pivot[j], ring[j], part)
            for a in range(0, len(i), 4096):
                some = pa.array(i[a : a + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 4096]), *(batch.column(c).take(some) for c in ("home", "uid", "v", "sure"))], ["cell", "home", "uid", "v", "sure"])

    return run


def cell_number(pivot, ring, part):
    return (pivot * ANNULI + ring) * (1 << 40) + part


def exact_top(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: exact top ``k`` by integer inner product of the vectors
    floor(``scale`` * x), x as double; ties to the smaller vec_id.

    Vectors null, empty or holding null or non-finite components take no part (zero vectors do);
    of rows equal in vec_id and vector, one counts; different vectors of one vec_id are candidates
    each, of other queries only, and as queries share the ``k`` ranks. Fewer candidates than ``k``: all. Vectors of different
    lengths are no candidates of each other. Empty table: no rows. Other columns are not read. Scores
    are 64-bit integers.
    """
    spark = vectors.sparkSession
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    data = usable(vectors).select("vec_id", whole.alias("v")).distinct()
    data = stage(data.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), "integers")

    def one(data: DataFrame, dim: int, n: int, radius: float) -> DataFrame:
        r2 = radius * radius * (1 + 1e-9)
        units, asks = _units(data, is_query, k + 1)
        units = stage(units, "units")
        chosen = np.array([r.v for r in units.orderBy(F.xxhash64("uid", F.lit(4)), "uid").limit(PIVOTS).select("v").collect()], np.int64)
        pivots = np.concatenate((chosen.astype(float), np.sqrt(np.maximum(r2 - (chosen.astype(float) ** 2).sum(1), 0))[:, None]), 1)
        schema = T.StructType([*units.schema.fields, T.StructField("pivot", T.LongType()), T.StructField("far", T.DoubleType())])
        keyed = stage(units.mapInArrow(_nearest_pivot(pivots, r2, dim), schema), "keyed")
        # Annuli of about CELL units each, by quantiles of the distances; what lies in few distances is split further.
        grid = [i / ANNULI for i in range(1, ANNULI)]
        edges = {r.pivot: (r.n, r.q) for r in keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("far", grid).alias("q")).collect()}
        many = {p: min(ANNULI, -(-n // CELL)) for p, (n, _) in edges.items()}
        cuts = {p: [q[round(ANNULI * j / many[p]) - 1] for j in range(1, many[p])] for p, (_, q) in edges.items()}
        ring = F.coalesce(*[F.when(F.col("pivot") == p, sum((F.col("far") > c).cast("long") for c in cut)) for p, cut in cuts.items() if cut], F.lit(0).cast("long"))
        keyed = keyed.withColumn("ring", ring)
        stats = keyed.groupBy("pivot", "ring").agg(F.min("far"), F.max("far"), F.ceil(F.count("*") / (4 * CELL)).cast("long")).collect()
        annuli = tuple(np.array(c) for c in zip(*stats))
        parts = F.coalesce(*[F.when((F.col("pivot") == p) & (F.col("ring") == r), F.lit(c)) for p, r, _, _, c in stats if c > 1], F.lit(1))
        cell = cell_number(F.col("pivot"), F.col("ring"), F.pmod(F.xxhash64("uid", F.lit(5)), parts))
        keyed = keyed.withColumn("cell", cell.cast("long"))
        run = _stream(k + 1, dim, np.int64, lambda c, x, ids: Annulus(x, ids, pivots[c // (1 << 40) // ANNULI], r2, k + 1))
        home = keyed.where("asked").select("cell", "uid", "v", F.lit(None).cast("double").alias("sure"))
        found = stage(_search(keyed, home, run, "long"), "found")
        asking = home.drop("sure").withColumnRenamed("cell", "home").join(_sure(found, k + 1), "uid", "left").select("home", "uid", "v", F.col("sure").cast("double").alias("sure"))
        away = asking.mapInArrow(_routes(pivots, r2, dim, annuli), "cell long, home long, uid long, v array<long>, sure double").where("cell <> home")
        return merge_top(found.unionByName(_search(keyed, away, run, "long")), asks, k)

    return _by_length(data, one) or spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op4_exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
