"""Registered queries over the test tables and their DuckDB equivalents.

Documents are cut into blocks of 200 words that share 150; series are the events' values per user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import CONTRACTIONS, DEFAULT_WORDS, DISPLAY_NAMES, METRICS, STOPWORDS, STYLE
from ..operators import blocks as B
from ..operators import compare as C
from ..operators import corpus as K
from ..operators import lexical as L
from ..operators import neighbours as N
from ..operators import series as X

SIZE, OVERLAP = 200, 150
STEP = SIZE - OVERLAP
RADIUS = 0.05


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.to_series(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"), F.col("label").alias("group"), F.element_at("embedding", 3).cast("double").alias("metric"))


def r(c: str, n: int = 8) -> F.Column:
    return F.round(c, n).alias(c)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- SQL that several oracles share ------------------------------------------------------------

WORDS = r"words AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM documents)"
BLOCKS = WORDS + f""", numbered AS (SELECT doc_id, ws, unnest(generate_series(0, (len(ws) - {SIZE}) // {STEP})) AS block FROM words WHERE len(ws) >= {SIZE}),
blocks AS (SELECT doc_id, CAST(block AS INTEGER) AS block, array_to_string(ws[block * {STEP} + 1 : block * {STEP} + {SIZE}], ' ') AS t FROM numbered)"""
TOKENS = BLOCKS + r""", toks AS (SELECT doc_id, block, regexp_extract_all(lower(t), '\p{L}+') AS ts FROM blocks),
placed AS (SELECT doc_id, block, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pos FROM toks),
counts AS (SELECT doc_id, block, tok, count(*) AS n, min(pos) AS first FROM placed GROUP BY ALL)"""
RICH = TOKENS + """, found AS (SELECT doc_id, block, sum(n) AS n_tokens, count(*) AS n_types, count(*) FILTER (n = 1) AS n_hapax, sum(n * (n - 1)) AS pairs FROM counts GROUP BY ALL),
rich AS (SELECT b.doc_id, b.block, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_types, 0) AS n_types, coalesce(n_hapax, 0) AS n_hapax,
  CASE WHEN n_tokens >= 2 THEN pairs / (CAST(n_tokens AS DOUBLE) * (n_tokens - 1)) ELSE 0.0 END AS simpson,
  CASE WHEN n_hapax < n_types THEN 100 * ln(CAST(n_tokens AS DOUBLE)) / (1 - CAST(n_hapax AS DOUBLE) / n_types) ELSE 0.0 END AS honore
  FROM blocks b LEFT JOIN found f ON b.doc_id = f.doc_id AND b.block = f.block)"""
LENGTHS = BLOCKS + r""", lengths AS (SELECT doc_id, block, len(regexp_extract_all(lower(t), '\p{L}+')) AS n_tokens, len(regexp_extract_all(t, '[^.!?]*[\p{L}\p{N}][^.!?]*')) AS n_sentences FROM blocks)"""
SERIES = "series AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CAST(value AS DOUBLE) AS value FROM events WHERE value IS NOT NULL)"
POINTS = "points AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS grp, CAST(embedding[3] AS DOUBLE) AS metric FROM embeddings)"
NEAR = POINTS + f", near AS (SELECT a.id AS center, b.id AS neighbour, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS distance FROM points a JOIN points b ON sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) < {RADIUS})"


# --- cleaning ----------------------------------------------------------------------------------

@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS cleaned, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS n_words FROM documents")
def clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.squeeze(F.col("text")).alias("cleaned"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


_SAID = " ".join([*CONTRACTIONS, *(k.upper() for k in CONTRACTIONS), *(f"'{k.capitalize()}'" for k in CONTRACTIONS), *(f"x{k}" for k in CONTRACTIONS)]) + " "


def _expansion_sql() -> str:
    out = "decorated"
    for k, v in CONTRACTIONS.items():
        out = f"regexp_replace({out}, '\\b{k.replace(chr(39), chr(39) * 2)}\\b', '{v}', 'gi')"
    return f"WITH d AS (SELECT doc_id, {quoted([_SAID])} || text AS decorated FROM documents) SELECT doc_id, " + out + " AS expanded FROM d"


@query(_expansion_sql())
def contractions(spark, sf_dir):
    """Every entry in several cases, in quotes and glued to a letter, before the whole text."""
    return docs(spark, sf_dir).select("doc_id", T.expand_contractions(F.concat(F.lit(_SAID), "text")).alias("expanded"))


@query()
def contractions_whole(spark, sf_dir):
    """Whole texts as they are, apostrophes and all; no SQL, tests hold it against brute force."""
    return docs(spark, sf_dir).select("doc_id", T.expand_contractions(F.col("text")).alias("expanded"))


MARKS = ("*** START OF THE PROJECT GUTENBERG EBOOK X ***", "*** END OF THE PROJECT GUTENBERG EBOOK X ***")


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '\n' || text || '\n' END AS body FROM documents".replace("\n", "' || chr(10) || '"))
def gutenberg_trim(spark, sf_dir):
    marked = F.concat(F.lit(f"head\n{MARKS[0]}\n"), "text", F.lit(f"\n{MARKS[1]}\nlicence"))
    return docs(spark, sf_dir).select("doc_id", T.gutenberg_trim(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(marked)).alias("body"))


@query("""WITH parts AS (SELECT doc_id, list_filter(list_transform(string_split_regex('preface ' || text || ' CHAPTER IV ' || text || ' Chapter 12' || text, '(?i)chapter\\s+[ivxlcdm\\d]+'),
  lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), lambda c: length(c) > 50) AS cs FROM documents)
SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS chapter, unnest(cs) AS body FROM parts""")
def chapters(spark, sf_dir):
    text = F.concat(F.lit("preface "), "text", F.lit(" CHAPTER IV "), "text", F.lit(" Chapter 12"), "text")
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.chapters(text)).alias("chapter", "body"))


@query("""SELECT doc_id, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS preview, left(text, 1000) || '...' AS always,
  CASE WHEN length(name) > 18 THEN left(name, 15) || '...' ELSE name END AS title, regexp_replace(name, '[^a-zA-Z0-9]', '_', 'g') AS safe, regexp_replace(name, '[^a-zA-Z0-9]', '', 'g') AS bare
  FROM (SELECT *, source || ' / ' || lang || ' No. ' || doc_id AS name FROM documents)""")
def previews(spark, sf_dir):
    t, name = F.col("text"), F.concat("source", F.lit(" / "), "lang", F.lit(" No. "), "doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", T.preview(t, 150).alias("preview"), T.preview(t, 1000, True).alias("always"), T.short_title(name).alias("title"), T.safe_id(name).alias("safe"), T.safe_id(name, "").alias("bare"))


@query("""SELECT doc_id, CASE WHEN length(text) > 18 THEN left(text, 15) || '...' ELSE text END AS title,
  regexp_replace(text, '[^a-zA-Z0-9]', '_', 'g') AS safe, regexp_replace(text, '[^a-zA-Z0-9]', '', 'g') AS bare FROM documents""")
def names_whole(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", T.short_title(t).alias("title"), T.safe_id(t).alias("safe"), T.safe_id(t, "").alias("bare"))


def _case(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


_KEYS = [*METRICS, *DISPLAY_NAMES, "other"]


@query("SELECT k, " + _case("k", DISPLAY_NAMES, "k") + " AS display_name, " + _case("k", {k: v[0] for k, v in METRICS.items()}, "k") + " AS label, " + _case("k", {k: v[1] for k, v in METRICS.items()}, "''") + " AS hint, "
       + _case("k", {k: v[2] for k, v in METRICS.items()}, "'低值'") + " AS low_end, " + _case("k", {k: v[3] for k, v in METRICS.items()}, "'高值'") + f" AS high_end FROM (SELECT unnest([{quoted(_KEYS)}]) AS k)")
def labels(spark, sf_dir):
    k = spark.range(1).select(F.explode(F.array(*map(F.lit, _KEYS))).alias("k"))
    low, high = T.metric_ends(F.col("k"))
    return k.select("k", T.display_name(F.col("k")).alias("display_name"), T.metric_label(F.col("k")).alias("label"), T.metric_hint(F.col("k")).alias("hint"), low.alias("low_end"), high.alias("high_end"))


# --- blocks ------------------------------------------------------------------------------------

@query(f"WITH {BLOCKS} SELECT doc_id, block, {SIZE} AS word_count, CASE WHEN length(t) > 150 THEN left(t, 150) || '...' ELSE t END AS preview, CASE WHEN length(t) > 1200 THEN left(t, 1200) || '...' ELSE t END AS extended_preview, length(t) AS n_chars FROM blocks")
def blocks_sliding(spark, sf_dir):
    b, t = B.blocks(docs(spark, sf_dir), SIZE, OVERLAP), F.col("block_text")
    return b.select("doc_id", "block", F.size("words").alias("word_count"), T.preview(t, 150).alias("preview"), T.preview(t, 1200).alias("extended_preview"), F.length(t).cast("long").alias("n_chars"))


@query(f"WITH {WORDS}, numbered AS (SELECT doc_id, ws, unnest(generate_series(0, (len(ws) - 100) // 100)) AS block FROM words WHERE len(ws) >= 100) SELECT doc_id, CAST(block AS INTEGER) AS block, array_to_string(ws[block * 100 + 1 : block * 100 + 100], ' ') AS block_text FROM numbered")
def blocks_tumbling(spark, sf_dir):
    return B.blocks(docs(spark, sf_dir), 100, 0).select("doc_id", "block", "block_text")


@query(f"WITH {TOKENS} SELECT doc_id, block, tok, n FROM counts")
def token_counts(spark, sf_dir):
    return B.token_panes(docs(spark, sf_dir), SIZE, OVERLAP).select("doc_id", "block", "tok", "n")


@query(f"WITH {RICH} SELECT doc_id, block, CAST(n_tokens AS BIGINT) AS n_tokens, n_types, n_hapax, round(simpson, 8) AS simpson, round(honore, 6) AS honore FROM rich")
def lexical_richness(spark, sf_dir):
    return L.lexical_richness(docs(spark, sf_dir), SIZE, OVERLAP).select("doc_id", "block", "n_tokens", "n_types", "n_hapax", r("simpson"), r("honore", 6))


@query(f"WITH {RICH} SELECT doc_id, block, round(simpson, 6) AS value FROM rich")
def simpson(spark, sf_dir):
    return L.lexical_richness(docs(spark, sf_dir), SIZE, OVERLAP).select("doc_id", "block", F.round("simpson", 6).alias("value"))


@query(f"WITH {RICH} SELECT doc_id, block, round(honore, 4) AS value FROM rich")
def honore(spark, sf_dir):
    return L.lexical_richness(docs(spark, sf_dir), SIZE, OVERLAP).select("doc_id", "block", F.round("honore", 4).alias("value"))


@query(f"WITH {LENGTHS} SELECT doc_id, block, n_tokens, n_sentences, round(CASE WHEN n_sentences > 0 THEN CAST(n_tokens AS DOUBLE) / n_sentences ELSE 0.0 END, 8) AS sentence_length FROM lengths")
def sentence_length(spark, sf_dir):
    return L.sentence_lengths(docs(spark, sf_dir), SIZE, OVERLAP).select("doc_id", "block", "n_tokens", "n_sentences", r("sentence_length"))


@query(f"WITH {TOKENS}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, block ORDER BY n DESC, first) AS INTEGER) AS rank FROM counts WHERE tok NOT IN ({quoted(STOPWORDS)})) SELECT doc_id, block, rank, tok, n FROM ranked WHERE rank <= 3")
def top_keywords(spark, sf_dir):
    return L.keyword_rows(docs(spark, sf_dir), SIZE, OVERLAP, n=3)


@query(f"WITH {BLOCKS}, t AS (SELECT doc_id, block, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS tok FROM blocks) SELECT doc_id, block, tok, count(*) AS n FROM t WHERE tok IN ({quoted(STOPWORDS)}) GROUP BY ALL")
def function_word_counts(spark, sf_dir):
    return L.function_words(docs(spark, sf_dir), SIZE, OVERLAP)


@query(f"WITH {RICH}, lengths AS (SELECT doc_id, block, len(regexp_extract_all(lower(t), '\\p{{L}}+')) AS n_tokens, len(regexp_extract_all(t, '[^.!?]*[\\p{{L}}\\p{{N}}][^.!?]*')) AS n_sentences FROM blocks) "
       f"SELECT r.doc_id, count(*) AS total_blocks, count(*) * {SIZE} AS total_words, round(avg(CASE WHEN n_sentences > 0 THEN CAST(l.n_tokens AS DOUBLE) / n_sentences ELSE 0.0 END), 2) AS avg_sentence_length, round(avg(simpson), 4) AS avg_simpson FROM rich r JOIN lengths l USING (doc_id, block) GROUP BY r.doc_id")
def book_metadata(spark, sf_dir):
    return K.metadata(docs(spark, sf_dir), SIZE, OVERLAP)


@query(f"WITH {TOKENS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY n DESC, first) AS rank FROM counts WHERE tok NOT IN ({quoted(STOPWORDS)})), k AS (SELECT tok FROM ranked WHERE rank <= 3 AND length(tok) < 12), n AS (SELECT count(*) AS c FROM k) "
       f"SELECT DISTINCT tok FROM k, n WHERE c >= 50 UNION ALL SELECT unnest([{quoted(DEFAULT_WORDS)}]) FROM n WHERE c < 50")
def keyword_vocabulary(spark, sf_dir):
    return K.vocabulary(top_keywords(spark, sf_dir))


@query(f"WITH {RICH}, ranked AS (SELECT doc_id AS series_id, block AS idx, round(simpson, 6) AS value, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(simpson, 6) DESC, block) AS INTEGER) AS rank FROM rich WHERE block BETWEEN 2 AND 20) SELECT series_id, rank, idx, value FROM ranked WHERE rank <= 3")
def brush_top3(spark, sf_dir):
    return K.brush(simpson(spark, sf_dir).select(F.col("doc_id").alias("series_id"), F.col("block").alias("idx"), "value"), 2, 20)


VALUES = RICH + r""", lengths AS (SELECT doc_id, block, CASE WHEN len(regexp_extract_all(t, '[^.!?]*[\p{L}\p{N}][^.!?]*')) > 0 THEN CAST(len(regexp_extract_all(lower(t), '\p{L}+')) AS DOUBLE) / len(regexp_extract_all(t, '[^.!?]*[\p{L}\p{N}][^.!?]*')) ELSE 0.0 END AS asl FROM blocks),
vals AS (SELECT doc_id AS series_id, 'simpsonIndex' AS metric, block AS idx, simpson AS value FROM rich UNION ALL SELECT doc_id, 'hapaxLegomena', block, honore FROM rich UNION ALL SELECT doc_id, 'sentenceLength', block, asl FROM lengths)"""
_MEASURED = ("sentenceLength", "simpsonIndex", "hapaxLegomena")


def values(spark, sf_dir, *metrics):
    return K.block_metrics(docs(spark, sf_dir), SIZE, OVERLAP, "doc_id", metrics or _MEASURED)


@query(f"WITH {VALUES} SELECT metric, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(min(value) * 0.95, 6) AS lo_pad, round(max(value) * 1.05, 6) AS hi_pad FROM vals GROUP BY metric")
def global_range(spark, sf_dir):
    return K.global_range(values(spark, sf_dir)).select("metric", r("lo", 6), r("hi", 6), r("lo_pad", 6), r("hi_pad", 6))


@query()
def global_range_all(spark, sf_dir):
    """All four metrics; the function words' plane has no SQL, tests hold it against a matrix decomposition."""
    return K.global_range(values(spark, sf_dir, *K.METRICS)).select("metric", r("lo", 6), r("hi", 6), r("lo_pad", 6), r("hi_pad", 6))


@query(f"WITH {VALUES} SELECT series_id, idx, round(value, 6) AS value FROM vals WHERE metric = 'sentenceLength'")
def metric_projection(spark, sf_dir):
    return values(spark, sf_dir, "sentenceLength").select("series_id", "idx", r("value", 6))


@query(f"WITH {VALUES}, e AS (SELECT metric, min(value) * 0.95 AS lo, max(value) * 1.05 AS hi FROM vals WHERE metric <> 'sentenceLength' GROUP BY metric) SELECT series_id, metric, idx, round(greatest(0, least(1, (value - lo) / (hi - lo))), 6) AS t FROM vals JOIN e USING (metric)")
def colour_position(spark, sf_dir):
    v = values(spark, sf_dir, "simpsonIndex", "hapaxLegomena")
    ends = K.global_range(v).select("metric", "lo_pad", "hi_pad")
    t = N.colour_position(F.col("value"), F.col("lo_pad"), F.col("hi_pad"))
    return v.join(ends, "metric").select("series_id", "metric", "idx", F.round(t, 6).alias("t"))


@query(f"WITH {RICH}, n AS (SELECT doc_id, count(*) AS n FROM rich GROUP BY doc_id) SELECT count(*) AS books, CAST(sum(n) AS BIGINT) AS total_blocks, max(n) AS longest, CAST(max(ceil(sqrt(n))) AS INTEGER) AS grid_rows FROM n")
def corpus_totals(spark, sf_dir):
    return K.totals(B.blocks(docs(spark, sf_dir), SIZE, OVERLAP).select(F.col("doc_id").alias("series_id")))


@query("SELECT doc_id, lang, source, n_chars, text FROM documents WHERE doc_id = 7")
def book_by_name(spark, sf_dir):
    return K.book_by_name(read(spark, sf_dir, "documents"), 7, "doc_id").select("doc_id", "lang", "source", "n_chars", "text")


@query("SELECT doc_id, lang, length(text) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def selected_books(spark, sf_dir):
    chosen = K.selected_books(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    return chosen.select("doc_id", "lang", F.length("text").cast("long").alias("n"))


@query("WITH s AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT doc_id FROM s WHERE doc_id <> (SELECT min(doc_id) FROM s) UNION ALL SELECT -1")
def toggle_selection(spark, sf_dir):
    s = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    least = s.agg(F.min("doc_id")).first()[0]
    return K.toggle(K.toggle(s, least, "doc_id"), -1, "doc_id")


@query("WITH m AS (SELECT min(doc_id) AS doc_id FROM documents) SELECT doc_id FROM m")
def first_book(spark, sf_dir):
    return K.first_book(read(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {RICH} SELECT doc_id, round(avg(simpson), 8) AS average FROM rich GROUP BY doc_id")
def sorted_books(spark, sf_dir):
    return K.sort_books(book_overview(spark, sf_dir), "average", True, "doc_id").select("doc_id", "average")


@query(f"WITH {BLOCKS} SELECT doc_id, block, doc_id = 7 AS highlight FROM blocks")
def hover_flag(spark, sf_dir):
    return K.hovered(B.blocks(docs(spark, sf_dir), SIZE, OVERLAP).select("doc_id", "block"), 7, "doc_id")


@query(f"WITH {BLOCKS} SELECT doc_id, t AS block_text FROM blocks WHERE block = 3")
def block_by_index(spark, sf_dir):
    return B.blocks(docs(spark, sf_dir), SIZE, OVERLAP).where("block = 3").select("doc_id", "block_text")


@query(f"WITH {WORDS} SELECT doc_id, len(ws) AS n_words FROM words WHERE len(ws) >= {SIZE}")
def books_with_blocks(spark, sf_dir):
    d = docs(spark, sf_dir)
    kept = K.nonempty(d, B.blocks(d, SIZE, OVERLAP).select(F.col("doc_id").alias("series_id"), F.col("block").alias("value")), "doc_id")
    return kept.select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


@query(f"WITH {TOKENS}, found AS (SELECT doc_id, block, sum(n) AS n_tokens, sum(n * (n - 1)) AS pairs FROM counts GROUP BY ALL), v AS (SELECT b.doc_id, b.block, t, CASE WHEN n_tokens >= 2 THEN pairs / (CAST(n_tokens AS DOUBLE) * (n_tokens - 1)) ELSE 0.0 END AS value FROM blocks b LEFT JOIN found f ON b.doc_id = f.doc_id AND b.block = f.block WHERE b.block BETWEEN 2 AND 20), "
       f"best AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, block) AS INTEGER) AS rank FROM v), kw AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY n DESC, first) AS k FROM counts WHERE tok NOT IN ({quoted(STOPWORDS)})), k3 AS (SELECT doc_id, block, string_agg(tok, ' ' ORDER BY k) AS keywords FROM kw WHERE k <= 3 GROUP BY ALL) "
       "SELECT best.doc_id AS series_id, rank, best.block AS idx, round(value, 6) AS value, CASE WHEN length(t) > 1200 THEN left(t, 1200) || '...' ELSE t END AS preview, coalesce(keywords, '') AS keywords FROM best LEFT JOIN k3 ON best.doc_id = k3.doc_id AND best.block = k3.block WHERE rank <= 3")
def brush_blocks(spark, sf_dir):
    out = K.brush_blocks(docs(spark, sf_dir), "simpsonIndex", 2, 20, 3, SIZE, OVERLAP)
    return out.select("series_id", "rank", "idx", r("value", 6), "preview", F.array_join("keywords", " ").alias("keywords"))


_VOCABULARY = list(dict.fromkeys(STOPWORDS))


@query(f"WITH {BLOCKS}, vocab AS (SELECT unnest([{quoted(_VOCABULARY)}]) AS tok, unnest(range({len(_VOCABULARY)})) AS pos), t AS (SELECT doc_id, block, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS tok FROM blocks), c AS (SELECT doc_id, block, tok, count(*) AS n FROM t GROUP BY ALL), every AS (SELECT doc_id, block, tok, pos FROM blocks, vocab) "
       "SELECT e.doc_id, e.block, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY pos) AS vector FROM every e LEFT JOIN c ON e.doc_id = c.doc_id AND e.block = c.block AND e.tok = c.tok GROUP BY e.doc_id, e.block")
def function_word_vectors(spark, sf_dir):
    return L.function_word_vectors(docs(spark, sf_dir), SIZE, OVERLAP).select("doc_id", "block", F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"))


@query(f"WITH {RICH}, m AS (SELECT doc_id, avg(simpson) AS a, count(*) AS n FROM rich GROUP BY doc_id) SELECT doc_id, round(a, 8) AS average, n AS n_blocks, CAST(ceil(sqrt(n)) AS INTEGER) AS grid_rows FROM m")
def book_overview(spark, sf_dir):
    out = L.lexical_richness(docs(spark, sf_dir), SIZE, OVERLAP).groupBy("doc_id").agg(F.round(F.avg("simpson"), 8).alias("average"), F.count("*").alias("n_blocks"))
    return out.withColumn("grid_rows", F.ceil(F.sqrt("n_blocks")).cast("int"))


# --- series ------------------------------------------------------------------------------------

@query(f"WITH {SERIES} SELECT series_id, idx, round(avg(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 8) AS value FROM series")
def smooth_series(spark, sf_dir):
    return X.smooth(series(spark, sf_dir), 3).select("series_id", F.col("idx").cast("long").alias("idx"), r("value"))


def _rolling_sql(f: str, first: str, name: str) -> str:
    arms = " ".join(f"WHEN width = {w} AND count(*) OVER w{w} = {w} THEN {f}(value) OVER w{w}" for w in range(2, 6))
    frames = ", ".join(f"w{w} AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING)" for w in range(2, 6))
    return f"WITH {SERIES}, s AS (SELECT *, CAST(least(5, count(*) OVER (PARTITION BY series_id) // 4) AS INTEGER) AS width FROM series) SELECT series_id, idx, width, round(CASE WHEN width <= 1 THEN {first} {arms} END, 8) AS {name} FROM s WINDOW {frames}"


@query(_rolling_sql("avg", "value", "moving_avg"))
def rolling_mean(spark, sf_dir):
    return X.rolling(series(spark, sf_dir)).select("series_id", F.col("idx").cast("long").alias("idx"), "width", r("moving_avg"))


@query(_rolling_sql("stddev_samp", "0.0", "moving_std"))
def rolling_std(spark, sf_dir):
    return X.rolling(series(spark, sf_dir)).select("series_id", F.col("idx").cast("long").alias("idx"), "width", r("moving_std"))


@query(f"WITH {SERIES} SELECT series_id, round(avg(value), 8) AS mean, round(median(value), 8) AS median, round(stddev_pop(value), 8) AS std, round(min(value), 8) AS min, round(max(value), 8) AS max, round(max(value) - min(value), 8) AS range, round(CASE WHEN avg(value) <> 0 THEN stddev_pop(value) / avg(value) ELSE 0.0 END, 8) AS cv, count(*) AS num_blocks FROM series GROUP BY series_id")
def series_stats(spark, sf_dir):
    return X.stats(series(spark, sf_dir)).select("series_id", *[r(c) for c in ("mean", "median", "std", "min", "max", "range", "cv")], "num_blocks")


@query(f"WITH {SERIES} SELECT series_id, round(regr_slope(value, idx), 8) AS slope, round(CASE WHEN stddev_pop(value) = 0 THEN 0.0 ELSE abs(corr(value, idx)) END, 8) AS strength, count(*) AS n FROM series GROUP BY series_id HAVING count(*) >= 2")
def series_trend(spark, sf_dir):
    return X.trend(series(spark, sf_dir)).select("series_id", r("slope"), r("strength"), "n")


@query()
def trend_pvalue(spark, sf_dir):
    return X.trend_p(series(spark, sf_dir)).select("series_id", r("p_value"))


@query(f"WITH {SERIES}, d AS (SELECT series_id, idx, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS d FROM series), e AS (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY idx) AS e FROM d) SELECT series_id, count(*) FILTER (d * e < 0) AS turning_points, round(coalesce(avg(abs(d)), 0.0), 8) AS volatility FROM e GROUP BY series_id")
def turning_points(spark, sf_dir):
    return X.turning(series(spark, sf_dir)).select("series_id", "turning_points", r("volatility"))


@query(f"WITH {SERIES}, f AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY series_id)), g AS (SELECT *, n >= 3 AND s > 0 AND abs(value - m) / s > 2 AS far FROM f) SELECT series_id, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (far), '') AS anomalies, count(*) FILTER (far) AS anomaly_count FROM g GROUP BY series_id")
def zscore_anomalies(spark, sf_dir):
    return X.zscore_anomalies(series(spark, sf_dir))


@query(f"WITH {SERIES}, q AS (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM series GROUP BY series_id HAVING count(*) >= 3), g AS (SELECT s.series_id, idx, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS far FROM series s JOIN q USING (series_id)) SELECT series_id, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (far), '') AS iqr_anomalies, count(*) FILTER (far) AS iqr_anomaly_count FROM g GROUP BY series_id")
def iqr_anomalies(spark, sf_dir):
    return X.iqr_anomalies(series(spark, sf_dir))


STYLED = ["Sentence Length", "Simpson Index", "Vocabulary", "Hapax", "Uniqueness", "PCA", "Function Words", "Else"]


def _style_sql() -> str:
    arm = lambda like, a, b, n: f"WHEN {like} THEN CASE WHEN mean < {a} THEN '{n[0]}' WHEN mean < {b} THEN '{n[1]}' ELSE '{n[2]}' END"
    kind = f"CASE {arm("metric LIKE '%Sentence Length%'", 15, 25, STYLE['sentence'])} {arm("metric LIKE '%Simpson%' OR metric LIKE '%Vocabulary%'", 0.1, 0.2, STYLE['simpson'])} {arm("metric LIKE '%Hapax%' OR metric LIKE '%Uniqueness%'", 50, 100, STYLE['hapax'])} WHEN metric LIKE '%PCA%' OR metric LIKE '%Function%' THEN CASE WHEN mean < 0 THEN '{STYLE['function'][0]}' ELSE '{STYLE['function'][1]}' END ELSE '{STYLE['other'][0]}' END"
    return f"WITH {SERIES}, f AS (SELECT series_id, unnest([{quoted(STYLED)}]) AS metric, mean, cv FROM (SELECT series_id, avg(value) AS mean, CASE WHEN avg(value) <> 0 THEN stddev_pop(value) / avg(value) ELSE 0.0 END AS cv FROM series GROUP BY series_id)) SELECT series_id, metric, {kind} || ' | ' || CASE WHEN cv > 0.3 THEN '{STYLE['steady'][0]}' WHEN cv > 0.15 THEN '{STYLE['steady'][1]}' ELSE '{STYLE['steady'][2]}' END AS style, {kind} AS primary_style FROM f"


@query(_style_sql())
def style_class(spark, sf_dir):
    s = X.stats(series(spark, sf_dir)).withColumn("metric", F.explode(F.array(*map(F.lit, STYLED))))
    out = s.select("series_id", "metric", X.style(F.col("metric"), F.col("mean"), F.col("cv")).alias("style"))
    return out.withColumn("primary_style", X.primary_style(F.col("style")))


@query(f"WITH {SERIES}, c AS (SELECT *, CAST(ceil(sqrt(count(*) OVER (PARTITION BY series_id))) AS INTEGER) AS grid_cols FROM series) SELECT series_id, idx, grid_cols, CAST(idx // grid_cols AS INTEGER) AS grid_row, CAST(idx % grid_cols AS INTEGER) AS grid_col FROM c")
def grid_layout(spark, sf_dir):
    return X.grid(series(spark, sf_dir)).select("series_id", F.col("idx").cast("long").alias("idx"), "grid_cols", "grid_row", "grid_col")


@query(f"WITH {SERIES}, q AS (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM series GROUP BY series_id) SELECT series_id, round(q1, 8) AS q1, round(med, 8) AS med, round(q3, 8) AS q3, round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)), 8) AS whislo, round(max(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)), 8) AS whishi FROM series JOIN q USING (series_id) GROUP BY ALL")
def boxplot_stats(spark, sf_dir):
    return X.box(series(spark, sf_dir)).select("series_id", *[r(c) for c in ("q1", "med", "q3", "whislo", "whishi")])


@query(f"WITH {SERIES}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series) SELECT series_id, idx, round(CAST(idx AS DOUBLE) / (n - 1), 8) AS position, round(value, 8) AS value FROM n WHERE n > 1")
def trend_lines(spark, sf_dir):
    return X.positions(series(spark, sf_dir)).select("series_id", F.col("idx").cast("long").alias("idx"), r("position"), r("value"))


SIMILAR = SERIES + """, n AS (SELECT series_id, list(value ORDER BY idx) AS v, count(*) AS n FROM series GROUP BY series_id),
g AS (SELECT series_id, v, n, unnest(generate_series(0, 99)) AS k FROM n),
s AS (SELECT series_id, k, v[least(CAST(floor(k * (n - 1) / 99.0) AS BIGINT), n - 1) + 1] AS a, v[least(least(CAST(floor(k * (n - 1) / 99.0) AS BIGINT), n - 1) + 1, n - 1) + 1] AS b, k * (n - 1) / CAST(99 AS DOUBLE) - least(floor(k * (n - 1) / 99.0), n - 1) AS f FROM g),
z AS (SELECT series_id, k, a + (b - a) * f AS x FROM s),
sim AS (SELECT i.series_id AS series_i, j.series_id AS series_j, coalesce(corr(i.x, j.x), 0.0) AS similarity FROM z i JOIN z j ON i.k = j.k AND i.series_id < j.series_id GROUP BY ALL)"""


@query(f"WITH {SIMILAR} SELECT series_i, series_j, round(CASE WHEN isnan(similarity) THEN 0.0 ELSE similarity END, 7) AS similarity FROM sim")
def series_similarity(spark, sf_dir):
    return C.similarity(series(spark, sf_dir)).select("series_i", "series_j", r("similarity", 7))


@query(f"WITH {SIMILAR}, clean AS (SELECT series_i, series_j, round(CASE WHEN isnan(similarity) THEN 0.0 ELSE similarity END, 7) AS similarity FROM sim) SELECT * FROM clean UNION ALL SELECT series_j, series_i, similarity FROM clean UNION ALL SELECT DISTINCT series_id, series_id, 1.0 FROM series")
def similarity_matrix(spark, sf_dir):
    return C.full_matrix(series(spark, sf_dir)).select("series_i", "series_j", r("similarity", 7))


@query(f"WITH {SIMILAR}, both_ AS (SELECT series_i AS series_id, similarity FROM sim UNION ALL SELECT series_j, similarity FROM sim), m AS (SELECT series_id, avg(similarity) AS a FROM both_ GROUP BY series_id) SELECT series_id, round(a, 7) AS mean_similarity FROM m ORDER BY round(a, 9), series_id LIMIT 1")
def most_unique(spark, sf_dir):
    return C.outlier(series(spark, sf_dir)).select("series_id", r("mean_similarity", 7))


@query(f"WITH {SIMILAR} SELECT series_i, series_j, round(similarity, 7) AS similarity FROM sim ORDER BY round(sim.similarity, 9) DESC, series_i, series_j LIMIT 1")
def most_similar_pair(spark, sf_dir):
    return C.closest_pair(series(spark, sf_dir)).select("series_i", "series_j", r("similarity", 7))


def _report_sql(metric: str) -> str:
    """The lines for a metric of sentence length; the test tables have no series of a name with 'huck'."""
    style = f"CASE WHEN mean < 15 THEN '{STYLE['sentence'][0]}' WHEN mean < 25 THEN '{STYLE['sentence'][1]}' ELSE '{STYLE['sentence'][2]}' END || ' | ' || CASE WHEN cv > 0.3 THEN '{STYLE['steady'][0]}' WHEN cv > 0.15 THEN '{STYLE['steady'][1]}' ELSE '{STYLE['steady'][2]}' END"
    fixed = lambda c, n: f"CAST(round(CAST({c} AS DECIMAL(28, 9)), {n}) AS VARCHAR)"
    line = f"'📖 书籍: ' || series_id || chr(10) || '  风格分类: ' || {style} || chr(10) || '  均值: ' || {fixed('mean', 2)} || ' ± ' || {fixed('std', 2)} || chr(10) || '  范围: ' || {fixed('lo', 2)} || ' - ' || {fixed('hi', 2)} || chr(10) || '  趋势: ' || CASE WHEN slope > 0.01 THEN '上升' WHEN slope < -0.01 THEN '下降' ELSE '平稳' END || ' (斜率: ' || {fixed('slope', 4)} || ')' || chr(10) || '  波动性: ' || {fixed('volatility', 4)} || chr(10) || '  异常值: ' || far || ' 个'"
    return f"""WITH {SIMILAR}, w AS (SELECT *, value - lag(value) OVER o AS d, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s, count(*) OVER p AS c FROM series WINDOW p AS (PARTITION BY series_id), o AS (PARTITION BY series_id ORDER BY idx)),
facts AS (SELECT series_id, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi, CASE WHEN avg(value) <> 0 THEN stddev_pop(value) / avg(value) ELSE 0.0 END AS cv, CASE WHEN count(*) >= 2 THEN regr_slope(value, idx) ELSE 0.0 END AS slope, coalesce(avg(abs(d)), 0.0) AS volatility, count(*) FILTER (c >= 3 AND s > 0 AND abs(value - m) / s > 2) AS far FROM w GROUP BY series_id),
both_ AS (SELECT series_i AS series_id, similarity FROM sim UNION ALL SELECT series_j, similarity FROM sim), alone AS (SELECT series_id FROM both_ GROUP BY series_id ORDER BY round(avg(similarity), 9), series_id LIMIT 1), pair AS (SELECT series_i, series_j FROM sim ORDER BY round(similarity, 9) DESC, series_i, series_j LIMIT 1)
SELECT 0 AS section, CAST(NULL AS VARCHAR) AS series_id, '📊 文学指纹分析报告' || chr(10) || '分析指标: {metric}' || chr(10) || '分析书籍: ' || count(*) || ' 本' AS line FROM facts
UNION ALL SELECT 1, CAST(series_id AS VARCHAR), {line} FROM facts UNION ALL SELECT 2, NULL, '🔄 跨书比较分析'
UNION ALL SELECT 3, CAST(series_id AS VARCHAR), '最独特的风格: ' || series_id FROM alone UNION ALL SELECT 4, NULL, '最相似的风格对: ' || series_i || ' ↔ ' || series_j FROM pair"""


@query(_report_sql("Sentence Length"))
def analysis_report(spark, sf_dir):
    return K.report(series(spark, sf_dir), "Sentence Length")


# --- neighbourhoods and drawing -----------------------------------------------------------------

@query(f"WITH {NEAR} SELECT center, neighbour, round(distance, 8) AS distance FROM near")
def neighbours(spark, sf_dir):
    return N.neighbours(points(spark, sf_dir), RADIUS).select("center", "neighbour", r("distance"))


@query(f"WITH {NEAR}, e AS (SELECT center, grp, count(*) AS n, sum(coalesce(metric, 0)) AS s FROM near JOIN points ON id = neighbour GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY n DESC, grp DESC) AS k, sum(n) OVER (PARTITION BY center) AS total, sum(s) OVER (PARTITION BY center) AS m FROM e) SELECT center, CAST(total AS BIGINT) AS n_neighbours, grp AS dominant, round(100.0 * n / CAST(total AS DOUBLE), 8) AS dominance_rate, round(m / total, 8) AS avg_metric FROM o WHERE k = 1")
def cluster_summary(spark, sf_dir):
    return N.cluster_summary(points(spark, sf_dir), RADIUS).select("center", "n_neighbours", "dominant", r("dominance_rate"), r("avg_metric"))


_WORDS_OF = "k AS (SELECT vec_id AS id, unnest([0, 1, 2]) AS pos, unnest(['label' || label, 'even' || vec_id % 2, 'mod' || vec_id % 7]) AS word FROM embeddings)"


@query(f"WITH {NEAR}, {_WORDS_OF}, c AS (SELECT center, word, count(*) AS count, min(neighbour * 4 + pos) AS first FROM near JOIN k ON k.id = neighbour GROUP BY center, word), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY center ORDER BY count DESC, first) AS INTEGER) AS rank FROM c) SELECT center, rank, word, count FROM o WHERE rank <= 5")
def cluster_keywords(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    words = e.select(F.col("vec_id").alias("id"), F.posexplode(F.array(F.concat(F.lit("label"), "label"), F.concat(F.lit("even"), F.col("vec_id") % 2), F.concat(F.lit("mod"), F.col("vec_id") % 7))).alias("pos", "word"))
    return N.cluster_keywords(points(spark, sf_dir), words, RADIUS)


@query(f"WITH {POINTS}, lim AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(metric) AS e, max(metric) AS f FROM points) SELECT id, round(60 + (800 - 120) * (x - a) / (b - a), 6) AS screen_x, round(60 + (600 - 120) * (y - c) / (d - c), 6) AS screen_y, round(4 + 14 * (sign(metric) * sqrt(abs(metric)) - sign(e) * sqrt(abs(e))) / (sign(f) * sqrt(abs(f)) - sign(e) * sqrt(abs(e))), 6) AS r FROM points, lim")
def radius_scale(spark, sf_dir):
    return N.layout(points(spark, sf_dir)).select("id", r("screen_x", 6), r("screen_y", 6), r("r", 6))


@query(f"WITH {RICH}, lengths AS (SELECT doc_id, block, len(regexp_extract_all(lower(t), '\\p{{L}}+')) AS a, len(regexp_extract_all(t, '[^.!?]*[\\p{{L}}\\p{{N}}][^.!?]*')) AS b FROM blocks) SELECT doc_id, block, round(simpson, 6) AS value, round(CASE WHEN b > 0 THEN CAST(a AS DOUBLE) / b ELSE 0.0 END, 6) AS sentence_length FROM rich JOIN lengths USING (doc_id, block)")
def positional_join(spark, sf_dir):
    return N.positional_join(simpson(spark, sf_dir), L.sentence_lengths(docs(spark, sf_dir), SIZE, OVERLAP).select("doc_id", "block", r("sentence_length", 6)))


@query()
def pca_coordinates(spark, sf_dir):
    return L.pca_coordinates(docs(spark, sf_dir), SIZE, OVERLAP)


@query()
def fingerprint_nested(spark, sf_dir):
    return K.fingerprints(docs(spark, sf_dir), SIZE, OVERLAP)


@query(f"""WITH {TOKENS}, found AS (SELECT doc_id, block, sum(n) AS n_tokens, count(*) AS n_types, count(*) FILTER (n = 1) AS n_hapax, sum(n * (n - 1)) AS pairs FROM counts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY n DESC, first) AS rank FROM counts WHERE tok NOT IN ({quoted(STOPWORDS)})),
kw AS (SELECT doc_id, block, string_agg(tok, ' ' ORDER BY rank) AS keywords FROM ranked WHERE rank <= 3 GROUP BY doc_id, block),
m AS (SELECT b.doc_id, b.block, b.t, coalesce(keywords, '') AS keywords, len(regexp_extract_all(t, '[^.!?]*[\\p{{L}}\\p{{N}}][^.!?]*')) AS s, coalesce(n_tokens, 0) AS n_tokens,
  CASE WHEN n_tokens >= 2 THEN pairs / (CAST(n_tokens AS DOUBLE) * (n_tokens - 1)) ELSE 0.0 END AS simpson,
  CASE WHEN n_hapax < n_types THEN 100 * ln(CAST(n_tokens AS DOUBLE)) / (1 - CAST(n_hapax AS DOUBLE) / n_types) ELSE 0.0 END AS honore
  FROM blocks b LEFT JOIN found f ON b.doc_id = f.doc_id AND b.block = f.block LEFT JOIN kw k ON b.doc_id = k.doc_id AND b.block = k.block)
SELECT doc_id, block, round(CASE WHEN s > 0 THEN CAST(n_tokens AS DOUBLE) / s ELSE 0.0 END, 4) AS sentence_length, round(simpson, 6) AS simpson, round(honore, 4) AS honore, keywords,
  CASE WHEN length(t) > 150 THEN left(t, 150) || '...' ELSE t END AS preview, CASE WHEN length(t) > 1200 THEN left(t, 1200) || '...' ELSE t END AS extended_preview, {SIZE} AS word_count,
  count(*) OVER w AS total_blocks, count(*) OVER w * {SIZE} AS total_words, round(avg(CASE WHEN s > 0 THEN CAST(n_tokens AS DOUBLE) / s ELSE 0.0 END) OVER w, 2) AS avg_sentence_length, round(avg(simpson) OVER w, 4) AS avg_simpson
FROM m WINDOW w AS (PARTITION BY doc_id)""")
def fingerprint_blocks(spark, sf_dir):
    """The nested records laid out again, a row a block, without the plane's coordinates."""
    f = K.fingerprints(docs(spark, sf_dir), SIZE, OVERLAP)
    zipped = F.explode(F.arrays_zip("sentenceLength", "simpsonIndex", "hapaxLegomena", "functionWords"))
    z = f.select("doc_id", "metadata", zipped.alias("z"))
    return z.select("doc_id", "z.sentenceLength.block", F.col("z.sentenceLength.value").alias("sentence_length"), F.col("z.simpsonIndex.value").alias("simpson"), F.col("z.hapaxLegomena.value").alias("honore"),
                    F.array_join("z.functionWords.keywords", " ").alias("keywords"), "z.simpsonIndex.preview", "z.functionWords.extended_preview", F.col("z.hapaxLegomena.wordCount").alias("word_count"),
                    F.col("metadata.totalBlocks").alias("total_blocks"), F.col("metadata.totalWords").alias("total_words"), F.col("metadata.avgSentenceLength").alias("avg_sentence_length"), F.col("metadata.avgSimpsonIndex").alias("avg_simpson"))


@query("SELECT doc_id AS book, 'new ' || text AS text FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0")
def corpus_upsert(spark, sf_dir):
    d = docs(spark, sf_dir).withColumnRenamed("doc_id", "book")
    return K.upsert(d, d.where("book % 10 = 0").withColumn("text", F.concat(F.lit("new "), "text")))
