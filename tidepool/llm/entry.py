"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op4_bpe
from .importance import OP11_SQL, op11_importance
from .learned_ann import op1_learned_ann
from .packing import op3_packing
from .page_text import op13_page_text
from .preference import OP10_SQL, op10_preference_format
from .projection_dedup import op9_projection_dedup
from .simhash import op6_simhash
from .spelling import OP12_SQL, op12_spelling
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op2_toxicity
from .token_output import op7_token_output
from .url_filter import OP8_SQL, op8_url_filter

QUERIES = {
    "op1_learned_ann": op1_learned_ann,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_bpe": op4_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_token_output": op7_token_output,
    "op8_url_filter": op8_url_filter,
    "op9_projection_dedup": op9_projection_dedup,
    "op10_preference_format": op10_preference_format,
    "op11_importance": op11_importance,
    "op12_spelling": op12_spelling,
    "op13_page_text": op13_page_text,
}
SQL = {"op8_url_filter": OP8_SQL, "op10_preference_format": OP10_SQL, "op11_importance": OP11_SQL, "op12_spelling": OP12_SQL}
