"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tidewire.llm import digest, filter_audit, hard_negatives, language_id, lm_score, mixing, near_dup, neighbours, packing, quality, token_counts, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_language_id": language_id.op4_language_id,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_warc": warc.op6_warc,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_near_dup": near_dup.op8_near_dup,
    "op9_nearest": neighbours.op9_nearest,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_fingerprints": digest.op11_fingerprints,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {"op1_url_filter": url_filter.ORACLE, "op6_warc": warc.ORACLE, "op8_near_dup": near_dup.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
