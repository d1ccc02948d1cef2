"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from retail_spark.llm import (alignment, byte_bpe, decontamination, filter_audit, hilbert_search, packing, quality_classifier, quality_rules,
                              secret_scan, sharding, simhash, token_counts, toxicity)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_token_id_output": packing.query,
    "op4_secret_scans": secret_scan.query,
    "op5_byte_level_bpe": byte_bpe.query,
    "op6_sharding": sharding.query,
    "op7_benchmark_decontamination": decontamination.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_token_counts": token_counts.query,
    "op10_toxicity": toxicity.query,
    "op11_nearest_neighbours": hilbert_search.query,
    "op12_tokenizer_alignment": alignment.query,
    "op13_filter_audit": filter_audit.query,
}

ORACLES = {
    "op1_quality_rules": quality_rules.SQL,
    "op7_benchmark_decontamination": decontamination.SQL,
    "op11_nearest_neighbours": hilbert_search.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
