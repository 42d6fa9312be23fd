"""Text cleaning and tokenising as column expressions: no shuffle, inside generated code.

Null in, null out, unless said otherwise. Words are what white space separates; tokens are runs of
letters (a hyphenated word is two tokens); a sentence is a stretch without ``.!?`` that has a letter or
digit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import CONTRACTIONS, DISPLAY_NAMES, METRICS, OTHER_ENDS

START = r"\*\*\* START OF THE PROJECT GUTENBERG EBOOK .* \*\*\*"
STOP = r"\*\*\* END OF THE PROJECT GUTENBERG EBOOK .* \*\*\*"
TOKEN = r"\p{L}+"
COUNTED = r"[\p{L}\p{N}_]{2,}"
SENTENCE = r"[^.!?]*[\p{L}\p{N}][^.!?]*"
CHAPTER = r"(?i)chapter\s+[ivxlcdm\d]+"


def gutenberg_trim(text: Column) -> Column:
    """What stands between the first start and the first end mark; the whole text unless it has
    both, nothing if the end comes first. Before white space is touched: marks end with their line."""
    head, tail = F.regexp_substr(text, F.lit(START)), F.regexp_substr(text, F.lit(STOP))
    begin = F.position(head, text) + F.length(head)
    end = F.position(tail, text)
    return F.when(head.isNotNull() & tail.isNotNull(), F.substring(text, begin, F.greatest(end - begin, F.lit(0)))).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def expand_contractions(text: Column) -> Column:
    """Known contractions in any case, whole words only, become lower-case words."""
    for short, long in CONTRACTIONS.items():
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_]){re.escape(short)}(?![\p{{L}}\p{{N}}_])", long)
    return text


def clean(text: Column) -> Column:
    return expand_contractions(squeeze(gutenberg_trim(text)))


def words(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def counted_tokens(text: Column) -> Column:
    """Tokens of function-word counting: two letters, digits or underscores at least."""
    return F.regexp_extract_all(F.lower(text), F.lit(COUNTED), F.lit(0))


def sentence_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)))


def preview(text: Column, n: int, always: bool = False) -> Column:
    """The first ``n`` characters, with dots if there are more (or ``always``)."""
    short = F.concat(F.substring(text, 1, n), F.lit("..."))
    return short if always else F.when(F.length(text) > n, short).otherwise(text)


def short_title(name: Column) -> Column:
    """Over 18 characters: the first 15 with dots."""
    return F.when(F.length(name) > 18, F.concat(F.substring(name, 1, 15), F.lit("..."))).otherwise(name)


def safe_id(name: Column, fill: str = "_") -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9]", fill)


def chapters(text: Column) -> Column:
    """Pieces between chapter headings, trimmed, of more than 50 characters."""
    return F.filter(F.transform(F.split(text, CHAPTER, -1), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: F.length(c) > 50)


def _look_up(key: Column, table: dict[str, str], default: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def display_name(name: Column) -> Column:
    return _look_up(name, DISPLAY_NAMES, name)


def metric_label(metric: Column) -> Column:
    return _look_up(metric, {k: v[0] for k, v in METRICS.items()}, metric)


def metric_hint(metric: Column) -> Column:
    return _look_up(metric, {k: v[1] for k, v in METRICS.items()}, F.lit(""))


def metric_ends(metric: Column) -> tuple[Column, Column]:
    return tuple(_look_up(metric, {k: v[i] for k, v in METRICS.items()}, F.lit(OTHER_ENDS[i - 2])) for i in (2, 3))


def is_text_file(name: Column) -> Column:
    return F.lower(name).endswith(".txt")


def file_stem(name: Column) -> Column:
    """File name without folders and last extension."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
