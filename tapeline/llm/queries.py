"""The queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from . import chat_format, decontaminate, divergence, language_id, line_dedup, mixing, neardup, pii, quality_model, quality_rules, sharding, spelling, token_counts

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_shard_by_bytes": sharding.op5_shard_by_bytes,
    "op6_pii": pii.op6_pii,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_quality_model": quality_model.op8_quality_model,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_language_id": language_id.op10_language_id,
    "op11_chat_format": chat_format.op11_chat_format,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

#: Where SQL cannot say it on whole tables (edit joins, Viterbi, CRC-32, learned models) tests/llm compares with brute force instead.
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE_OP1,
    "op4_near_duplicates": neardup.ORACLE_OP4,
    "op7_quality_rules": quality_rules.ORACLE_OP7,
    "op9_mix_sources": mixing.ORACLE_OP9,
    "op11_chat_format": chat_format.ORACLE_OP11,
    "op12_source_divergence": divergence.ORACLE_OP12,
}
