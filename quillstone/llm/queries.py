"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from quillstone.llm import (
    chat_format,
    conversation_repair,
    decontamination,
    exact_dedup,
    harmonic,
    language_id,
    lexical_search,
    license_scan,
    packing,
    privacy,
    quality,
    sharding,
    simhash,
)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_language_id": language_id.op2_language_id,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_sharding": sharding.op4_sharding,
    "op5_pii": privacy.op5_pii,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_harmonic_packing": harmonic.op11_harmonic_packing,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_ranked_search": lexical_search.op13_ranked_search,
}

#: The others have no SQL: learned models, a tokenizer, XXH64; tests hold them against brute force.
ORACLE_SQL = {
    "op1_license_scan": license_scan.ORACLE_SQL,
    "op4_sharding": sharding.ORACLE_SQL,
    "op5_pii": privacy.ORACLE_SQL,
    "op8_chat_format": chat_format.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_harmonic_packing": harmonic.op11_harmonic_packing,
    "op12_conversation_repair": conversation_repair.ORACLE_SQL,
    "op13_ranked_search": lexical_search.ORACLE_SQL,
}
