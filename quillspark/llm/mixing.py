"""Soft-membership mixing to target token weights (operator 8, native).

A classifier learned from (a bounded sample of) the labelled table gives each document a posterior over domains: its words and
their endings are hashed into buckets, each with its log-likelihood ratio by document counts; the mean
ratio over a document's buckets and its size are codes of a naive Bayes layer, counted on the labelled
table, too, so that posteriors stay graded however long a text is. Projected gradient steps then fit nonnegative document rates so that the
expected token total of every domain, sum over documents of rate * tokens * posterior, meets its
target. A step is preconditioned by the domains' K x K second moments over the documents that are
not at the bound, and steps go on until nothing is left to gain. A step needs only the domains' sums,
so nothing but those reaches the driver. DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import columns, stage, table, text_key, unused

#: Domains, by the labelled table: (name, predicate on its columns).
DOMAINS = [("good", "quality = 1"), ("low", "quality = 0")]
#: Target weights: each domain's share of the expected tokens, of as many tokens as the corpus has.
SHARES = {"good": 0.95, "low": 0.05}
#: Weight, in the loss, of the rates' distance from 1 against that of the targets (over the curvature).
PULL = 1e-8
#: Steps end with a gradient of this share of all tokens; a target off by more than UNMET is reported.
TOLERANCE, UNMET = 1e-9, 1e-6


#: Labelled rows of each domain (those of least hash) that word ratios are learned from, at most.
SAMPLE = 10_000
#: Hash buckets of words, and of words' endings of ENDING characters; both are parameters of the model.
BUCKETS, ENDING = 2048, 2
#: A mean ratio times SCALE, from -HALF to HALF, is a code; so is the binary logarithm of a text's size.
SCALE, HALF, LENGTHS = 20, 30, 24


def buckets(text) -> "F.Column":
    """The distinct hash buckets of a text's words (between white space) and of their endings."""
    words = F.split(F.translate(text, "\n\t\r", "   "), " ")
    whole = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    ends = F.transform(words, lambda w: (BUCKETS + F.pmod(F.xxhash64(F.right(w, F.lit(ENDING))), F.lit(BUCKETS))).cast("int"))
    return F.array_distinct(F.concat(whole, ends))


def _sum_of(weights, places) -> "F.Column":
    return F.aggregate(places, F.lit(0.0), lambda s, k: s + F.element_at(weights, k + 1))


def domains(labels: DataFrame) -> DataFrame:
    """``(_d, domain)``: the number of each labelled document's domain; one that is labelled twice has one."""
    named = F.coalesce(*[F.when(F.expr(when), F.lit(i)) for i, (_, when) in enumerate(DOMAINS)])
    marked = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_d"), named.alias("domain")).where("domain IS NOT NULL")
    return marked.groupBy("_d").agg(F.max("domain").alias("domain"))


def described(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, _row, tokens, f_...)``: tokens of a text (blanks and line breaks plus one, 0 without
    other characters) and the codes of the classifier. A null text counts as empty. Ratios are
    learned from ``SAMPLE`` labelled rows of each domain, so that no text is shuffled for them; the
    counts of buckets and domains that reach the driver are bounded by both."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text)
    count = lambda what: size - F.octet_length(F.replace(text, F.lit(what), F.lit("")))
    bare = F.octet_length(F.trim(text)) == 0
    tokens = F.when(bare, F.lit(0)).otherwise(count(" ") + count("\n") + 1).cast("long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = None
    for i in range(len(DOMAINS)):  # a top-k by hash each, not a sort of all rows
        part = domains(labels).where(F.col("domain") == i).orderBy(F.xxhash64("_d"), "_d").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    # As many ids as SAMPLE allows: the bounded side is broadcast.
    seen = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("_d")).select("domain", buckets(text).alias("b"))
    per = seen.select("domain", F.explode(F.concat("b", F.array(F.lit(-1)))).alias("b")).groupBy("domain", "b").count().collect()
    df = {(r.domain, r.b): r["count"] for r in per}
    n = [df.get((i, -1), 0) for i in range(len(DOMAINS))]
    share = lambda hits, of: math.log((hits + 0.5) / (of + 1.0))
    b = F.col("_b")
    codes = {}
    for i, (name, _) in enumerate(DOMAINS[1:], 1):  # each domain but the first against all others
        ratio = [share(df.get((i, k), 0), n[i]) - share(sum(df.get((j, k), 0) for j in range(len(n)) if j != i), sum(n) - n[i]) for k in range(2 * BUCKETS)]
        weights = F.expr(f"cast(split('{','.join(f'{x:.4f}' for x in ratio)}', ',') AS array<double>)")
        mean = _sum_of(weights, b) / F.greatest(F.size(b), F.lit(1))
        codes[f"f_{name}"] = (F.least(F.greatest(F.floor(mean * SCALE), F.lit(-HALF)), F.lit(HALF)) + HALF).cast("int")
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("_row"), tokens.alias("tokens"), buckets(text).alias("_b"), F.least(F.floor(F.log2(size + 1)), F.lit(LENGTHS)).cast("int").alias("f_size"))
    return facts.select("doc_id", "_row", "tokens", "f_size", *[c.alias(k) for k, c in codes.items()])


def posteriors(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``p``, the array of domain posteriors, to ``facts``. Likelihoods are counted over all
    labelled rows with add-one smoothing. Counts per (domain, feature, code) are bounded by the codes'
    ranges whatever the corpus; they become literals of the plan. Without labelled rows all
    domains are equally likely."""
    features = sorted(c for c in facts.columns if c.startswith("f_"))
    k = len(DOMAINS)
    seen = facts.join(domains(labels), F.col("doc_id") == F.col("_d"))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("code")) for i, f in enumerate(features)]))
    table_ = {(r.domain, r.feature, r.code): r["count"] for r in seen.select("domain", pairs.alias("x")).groupBy("domain", "x.feature", "x.code").count().collect()}
    n = [sum(c for (d, f, _), c in table_.items() if d == i and f == 0) for i in range(k)]
    log_p = [F.lit(math.log((n[i] + 1) / (sum(n) + k))) for i in range(k)]
    for j, f in enumerate(features):
        top = LENGTHS if f == "f_size" else 2 * HALF
        for i in range(k):
            likely = [math.log((table_.get((i, j, c), 0) + 1) / (n[i] + top + 1)) for c in range(top + 1)]
            log_p[i] = log_p[i] + F.element_at(F.array(*map(F.lit, likely)), F.col(f) + 1)
    scored = facts.select("*", *[x.alias(f"_l{i}") for i, x in enumerate(log_p)])
    most = F.greatest(*[F.col(f"_l{i}") for i in range(k)])
    scored = scored.select("*", *[F.exp(F.col(f"_l{i}") - most).alias(f"_e{i}") for i in range(k)])
    total = sum(F.col(f"_e{i}") for i in range(k))
    return scored.select("doc_id", "_row", "tokens", F.array(*[F.col(f"_e{i}") / total for i in range(k)]).alias("p"))


def fit_rates(facts: DataFrame, targets: list[float] | None = None, shares: dict[str, float] | None = None, floor: float = 0.0, told: dict | None = None) -> DataFrame:
    """Adds ``rate`` (``floor`` or more, 1 before any step) to rows with ``tokens`` and ``p``.

    Minimises half the sum over domains of (S_c - T_c)^2, S_c = sum of rate * tokens * p_c; of the
    rates that do, those nearest to 1 (in squares weighed by tokens) are taken. They have the form
    max(``floor``, 1 - p . y) with K numbers y, which projected gradient steps find: each takes the
    gradient in y times the inverse of the K x K sums of tokens * p_c * p_d over the documents
    whose rate is not at the bound, halved while it doesn't gain enough. A small ridge around a
    centre keeps y finite; the centre moves to the y found until that brings no total nearer to its
    target. The problem is convex, and quadratic between bounds, so the steps end at its solution:
    there is no cap on them. Where ``floor`` or the posteriors put a target out of reach the rates
    are those of least loss, and a warning gives the totals met.
    ``targets`` are token totals; by default ``shares`` of the corpus's tokens. Documents without
    tokens keep rate 1. ``told``: gets the number of steps, the totals met and the targets.
    """
    k = len(DOMAINS)
    p = [F.element_at("p", i + 1) for i in range(k)]
    move = lambda y: sum(p[i] * F.lit(float(y[i])) for i in range(k))
    rate = lambda y: F.greatest(1 - move(y), F.lit(float(floor)))

    def at(y: list[float]) -> tuple[float, list[float], list[list[float]]]:
        """Sum of tokens times the integral of the rate along y, the domains' totals, and their moments over the free documents."""
        u, loose = move(y), 1 - move(y) >= floor
        # u - u^2 / 2 up to the bound, from there on floor times what follows.
        edge = 1.0 - floor
        area = F.when(loose, u - u * u / 2).otherwise(F.lit(edge - edge * edge / 2) + (u - edge) * floor)
        weigh = lambda x: F.coalesce(F.sum(F.col("tokens") * x), F.lit(0.0))
        got = facts.agg(weigh(area), *[weigh(rate(y) * p[i]) for i in range(k)], *[weigh(F.when(loose, p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(k)]).first()
        return got[0], list(got[1 : k + 1]), [list(got[k + 1 + i * k : k + 1 + i * k + k]) for i in range(k)]

    *base, full = facts.agg(*[F.coalesce(F.sum(F.col("tokens") * x), F.lit(0.0)) for x in (*p, sum(q * q for q in p))]).first()
    if targets is None:
        targets = [sum(base) * (shares or SHARES)[name] for name, _ in DOMAINS]
    total, ridge = sum(base) or 1.0, PULL * (full or 1.0)
    dot = lambda x, z: sum(i * j for i, j in zip(x, z))

    def state(y: list[float], centre: list[float]):
        area, now, a = at(y)
        d = [i - j for i, j in zip(y, centre)]
        return dot(targets, y) - area + ridge * dot(d, d) / 2, [t - s + ridge * x for t, s, x in zip(targets, now, d)], a, now

    def done(slope: list[float], y: list[float], share: float = TOLERANCE) -> bool:
        return max(map(abs, slope)) <= total * (share + 4e-16 * max(map(abs, y)))  # the second: rounding of p . y

    y, last, steps = [0.0] * k, float("inf"), 0
    while True:
        centre, (value, slope, a, now) = y, state(y, y)
        off = max(abs(t - s) for t, s in zip(targets, now))
        if off <= TOLERANCE * total or off > 0.9 * last:
            break
        last = off
        while not done(slope, y):
            step, length = _solve(a, [-g for g in slope], ridge), 1.0
            while length > 1e-9:
                there = [x + length * d for x, d in zip(y, step)]
                ahead = state(there, centre)
                if ahead[0] <= value + 1e-4 * length * dot(slope, step) or done(ahead[1], there):
                    break
                length /= 2
            else:  # what is left is rounding, or it isn't solved
                if done(slope, y, UNMET):
                    break
                raise ArithmeticError(f"rates: no step gains from {y}, gradient {slope}")
            y, (value, slope, a, now) = there, ahead
            steps += 1
    if told is not None:
        told.update(steps=steps, met=now, targets=targets)
    missed = [f"{DOMAINS[i][0]} {now[i]:.6g} of {targets[i]:.6g}" for i in range(k) if abs(now[i] - targets[i]) > UNMET * total]
    if missed:
        warnings.warn(f"token targets not met, out of reach with rates of {floor:g} and more: {', '.join(missed)}", stacklevel=2)
    return facts.withColumn("rate", F.when(F.col("tokens") > 0, rate(y)).otherwise(F.lit(1.0)))


def _solve(a: list[list[float]], b: list[float], ridge: float) -> list[float]:
    """Gaussian elimination of a small ridge system."""
    n = len(b)
    m = [[a[i][j] + (ridge if i == j else 0.0) for j in range(n)] + [b[i]] for i in range(n)]
    for i in range(n):
        best = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[best] = m[best], m[i]
        for r in range(n):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i])]
    return [m[i][n] / m[i][i] for i in range(n)]


def mix(docs: DataFrame, labels: DataFrame, targets: list[float] | None = None, shares: dict[str, float] | None = None, floor: float = 0.0) -> DataFrame:
    """``(doc_id, _row, tokens, p, rate, copies)``, one row per distinct (doc_id, text).

    ``copies`` is the rate made whole: its whole part, and one more for the share of documents that
    its fraction gives, by a hash of (doc_id, text), so it is the same on every run. Null and empty
    texts have no tokens and rate 1. Labels with nulls, or for unknown documents, are not used; a
    doc_id labelled twice has one label. Rows equal in doc_id and text are one; a null doc_id is
    scored like others. Empty table: no rows. Extra columns are not read.
    """
    facts = stage(described(docs, labels).distinct(), "facts")
    rated = fit_rates(stage(posteriors(facts, labels), "posteriors"), targets, shares, floor=floor)
    dice = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "_row", F.lit(8)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rated.withColumn("copies", (F.floor("rate") + (dice < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def apply_mix(docs: DataFrame, labels: DataFrame, floor: float = 0.0, shares: dict[str, float] | None = None) -> DataFrame:
    """The documents, each as often as its ``copies``; columns stay, whatever their names."""
    d, r, n, key, one = unused(docs, "d", "r", "copies", "key", "one")
    mixed = mix(docs, labels, shares=shares, floor=floor).select(F.col("doc_id").alias(d), F.col("_row").alias(r), F.col("copies").alias(n)).where(F.col(n) > 0)
    joined = docs.withColumn(key, text_key()).join(mixed, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(r)))
    return joined.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*columns(docs.columns))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, the posterior of each domain, the fitted rate and the copies."""
    out = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "tokens", *[F.element_at("p", i + 1).alias(f"p_{name}") for i, (name, _) in enumerate(DOMAINS)], "rate", "copies")
