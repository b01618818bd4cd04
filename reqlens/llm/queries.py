"""Registered queries of the training-data operators."""

from __future__ import annotations

from reqlens.llm import (op1_decontamination, op2_license_scan, op3_token_counts, op4_minhash, op5_mixing, op6_pii,
                         op7_quality_rules, op8_quality_classifier, op9_token_ids, op10_pitman_yor,
                         op11_substring_dedup, op12_hard_negatives, op13_prefix_trie)

QUERIES = {
    "op1_decontamination": op1_decontamination.query,
    "op2_license_scan": op2_license_scan.query,
    "op3_token_counts": op3_token_counts.query,
    "op4_minhash": op4_minhash.query,
    "op5_mixing": op5_mixing.query,
    "op6_pii": op6_pii.query,
    "op7_quality_rules": op7_quality_rules.query,
    "op8_quality_classifier": op8_quality_classifier.query,
    "op9_token_ids": op9_token_ids.query,
    "op10_pitman_yor": op10_pitman_yor.query,
    "op11_substring_dedup": op11_substring_dedup.query,
    "op12_hard_negatives": op12_hard_negatives.query,
    "op13_prefix_trie": op13_prefix_trie.query,
}
#: none of the first ten: each rests on compression, sampling, sketches, hashes of Spark's own or a tokenizer, which SQL lacks
ORACLES: dict[str, str] = {
    "op11_substring_dedup": op11_substring_dedup.ORACLE,
    "op12_hard_negatives": op12_hard_negatives.ORACLE,
    "op13_prefix_trie": op13_prefix_trie.ORACLE,
}
