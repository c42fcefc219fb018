"""The operators' queries and, where SQL can express them, the SQL for the same rows."""

from __future__ import annotations

from . import chosen_path, decontamination, filter_audit, jaccard_join, licenses, packing, pii, quality_classifier, quality_rules, substring_dedup, token_alignment, token_counts, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_ngram_jaccard_join": jaccard_join.query,
    "op3_license_scan": licenses.query,
    "op4_packing": packing.query,
    "op5_benchmark_decontamination": decontamination.query,
    "op6_toxicity": toxicity.query,
    "op7_pii": pii.query,
    "op8_quality_rules": quality_rules.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_token_counts": token_counts.query,
    "op11_chosen_path": chosen_path.query,
    "op12_token_alignment": token_alignment.query,
    "op13_filter_audit": filter_audit.query,
}

SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_ngram_jaccard_join": jaccard_join.ORACLE,
    "op3_license_scan": licenses.ORACLE,
    "op5_benchmark_decontamination": decontamination.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op11_chosen_path": chosen_path.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
