"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import queries as Q
from . import sql as S

QUERIES = {
    "op1_byte_bpe": Q.op1_byte_bpe,
    "op2_neighbours": Q.op2_neighbours,
    "op3_substring_dedup": Q.op3_substring_dedup,
    "op4_quality_rules": Q.op4_quality_rules,
    "op5_simhash": Q.op5_simhash,
    "op6_token_counts": Q.op6_token_counts,
    "op7_html_text": Q.op7_html_text,
    "op8_sharding": Q.op8_sharding,
    "op9_lm_scores": Q.op9_lm_scores,
    "op10_mixing": Q.op10_mixing,
    "op11_quality_classifier": Q.op11_quality_classifier,
    "op12_ranked_search": Q.op12_ranked_search,
    "op13_whitening": Q.op13_whitening,
}

ORACLE = S.ORACLE
