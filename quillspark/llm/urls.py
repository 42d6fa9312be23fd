"""URL filters: host-suffix and path-prefix expressions against hashed rules (operator 5, native).

Every URL is expanded into the expressions a rule could have been written as, each is hashed with
SHA-256, an equi-join on the first hex digits finds candidate rules, the full digest confirms them,
and the longest rule wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import columns, table, unused

#: (verdict, host and path) of the rules of the op5 query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: What a URL gets that no rule fits: a blocklist lets pass what it doesn't know.
DEFAULT_VERDICT = "allow"
SHORT = 8  # hex digits of a digest that the equi-join uses


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host`` and ``path``; a null URL or one without ``://`` has both empty."""
    q = "`" + url.replace("`", "``") + "`"
    rest = f"substring({q}, instr({q}, '://') + 3)"
    raw = f"substring_index(substring_index(substring_index({rest}, '/', 1), '?', 1), '#', 1)"
    path = f"substring_index(substring_index(substring({rest}, length({raw}) + 1), '?', 1), '#', 1)"
    there = f"instr({q}, '://') > 0"
    lower = f"translate({raw}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return df.withColumns({
        "host": F.expr(f"CASE WHEN {there} THEN {lower} ELSE '' END"),
        "path": F.expr(f"CASE WHEN {there} THEN {path} ELSE '' END"),
    })


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) rows with digest, its short prefix and the rule's path length."""
    df = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])))
    cut = F.instr("rule", "/")
    return df.select(
        "rule", "verdict",
        F.sha2("rule", 256).alias("digest"), F.substring(F.sha2("rule", 256), 1, SHORT).alias("short"),
        F.when(cut > 0, F.length("rule") - cut + 1).otherwise(0).alias("path_len"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, path_lengths: list[int], url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``.

    ``rules``: of :func:`rules_table`; ``path_lengths``: the distinct path lengths of the rules, so
    that only prefixes some rule could equal are made (the short list is a property of the rule
    set, not of the data). A rule fits its host and all subdomains where the URL's path starts
    with the rule's path, at any character; the longest rule (then the smaller string) wins.

    Null or malformed URL: both parts empty, no rule, the default verdict. Repeated URLs are judged
    once and joined back, so repeated rows stay repeated and one hot URL or host costs one row in
    the expansion. Empty table: no rows. Extra columns stay; columns named host, path, rule or
    verdict are replaced.
    """
    pages = pages.drop(*({"host", "path", "rule", "verdict"} - {url}))
    u, best_ = unused(pages, "u", "best")
    own = columns([url])[0]
    distinct = split_url(pages.select(own.alias("u")).where("u IS NOT NULL").distinct(), "u").where("host <> ''")
    lengths = "array(" + ",".join(map(str, sorted(set(path_lengths)))) + ")" if path_lengths else "cast(array() as array<int>)"
    expressions = F.expr(f"""
        flatten(transform(sequence(1, size(split(host, '[.]'))), i ->
            transform(filter({lengths}, n -> length(path) >= n), n ->
                concat(array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'), substring(path, 1, n)))))""")
    tried = distinct.select("u", F.explode(expressions).alias("e")).select("u", F.sha2("e", 256).alias("full"))
    # The rule side is small for sure: a rule list is configuration, and the threshold checks its size.
    hits = tried.join(rules, (F.substring("full", 1, SHORT) == F.col("short")) & (F.col("full") == F.col("digest")))
    best = hits.groupBy("u").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rule") - F.col("path_len"), "rule")).alias(best_)).withColumnRenamed("u", u)
    # Null URLs fit nothing: each is dealt out by its row. A hot URL's rows are the side of the join
    # that can be split, and meet one row of the judged ones.
    row = F.xxhash64(*columns([c for c, kind in pages.dtypes if "map<" not in kind]))
    joined = pages.join(best, F.coalesce(own, F.concat(F.lit("\0"), row.cast("string"))) == F.col(u), "left").drop(u)
    return split_url(joined, url).withColumns({"rule": F.col(f"{best_}.rule"), "verdict": F.coalesce(F.col(f"{best_}.verdict"), F.lit(default))}).drop(best_)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rules_table(spark, RULES)
    lengths = sorted({len(r) - r.index("/") for _, r in RULES})
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules, lengths).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH parts AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts),
named AS (
  SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM cut),
rules(rhost, rpath, rule, verdict) AS (VALUES
  ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'),
  ('net', '/de/', 'net/de/', 'allow'), ('example.net', '/de/8', 'example.net/de/8', 'block'),
  ('org', '/es/', 'org/es/', 'block')),
fit AS (
  SELECT n.page_id, n.host, n.path, (
    SELECT max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM rules r
    WHERE (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath)) AS best
  FROM named n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM fit
"""
