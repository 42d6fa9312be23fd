"""The queries of this subpackage, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op9_bpe
from .chat import OP6_SQL, op6_chat_perspectives
from .line_dedup import op10_line_dedup
from .mixing import op8_soft_mixing
from .ngram_join import op1_ngram_jaccard
from .substring_dedup import op2_substring_dedup
from .toxicity import op7_toxicity
from .urls import OP5_SQL, op5_url_filters
from .vectors import OP4_SQL, op3_neighbours, op4_exact_top

QUERIES = {
    "op2_substring_dedup": op2_substring_dedup,
    "op6_chat_perspectives": op6_chat_perspectives,
    "op8_soft_mixing": op8_soft_mixing,
    "op3_neighbours": op3_neighbours,
    "op4_exact_top": op4_exact_top,
    "op7_toxicity": op7_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op5_url_filters": op5_url_filters,
    "op9_bpe": op9_bpe,
}
ORACLES = {"op6_chat_perspectives": OP6_SQL, "op4_exact_top": OP4_SQL, "op5_url_filters": OP5_SQL}
