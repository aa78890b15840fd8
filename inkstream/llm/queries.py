"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import chat, edit_fingerprint, html_crf, line_dedup, lm_scoring, media, mixing, ngram_join, packing, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1,
    "op2_chat_formatting": chat.op2,
    "op3_best_fit_packing": packing.op3,
    "op4_line_dedup": line_dedup.op4,
    "op5_toxicity": toxicity.op5,
    "op6_edit_fingerprint": edit_fingerprint.op6,
    "op7_lm_scoring": lm_scoring.op7,
    "op8_html_extraction": html_crf.op8,
    "op9_mix_sources": mixing.op9,
    "op10_media_columns": media.op10,
}

ORACLES = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op8_html_extraction": html_crf.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
}
