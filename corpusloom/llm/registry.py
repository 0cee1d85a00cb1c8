"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from corpusloom.llm import (
    codec,
    exact_dedup,
    html_text,
    jaccard_join,
    licenses,
    line_dedup,
    minhash,
    negatives,
    packing,
    quality,
    quotations,
    repair,
    secrets,
)

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_license_scans": licenses.op2_license_scans,
    "op3_chat_formatting": quotations.op3_chat_formatting,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_substring_dedup": line_dedup.op8_substring_dedup,
    "op9_html_extraction": html_text.op9_html_extraction,
    "op10_bpe": codec.op10_bpe,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_minhash_dedup": minhash.op13_minhash_dedup,
}
SQL = quality.SQL | exact_dedup.SQL | quotations.SQL | line_dedup.SQL | negatives.SQL | repair.SQL | jaccard_join.SQL | minhash.SQL
