"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import divergence, exact_dedup, language_id, lm_scoring, mixing, near_dedup, packing, quality_rules, repeats, secrets, sentencepiece_codec, spelling, token_counts

QUERIES = {
    "op1_near_duplicates": near_dedup.op1_near_duplicates,
    "op2_language_id": language_id.op2_language_id,
    "op3_lm_scores": lm_scoring.op3_lm_scores,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_scan_secrets": secrets.op5_scan_secrets,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_packed_tokens": packing.op9_packed_tokens,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_repeated_bytes": repeats.op12_repeated_bytes,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
SQL = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op11_source_divergence": divergence.SQL,
}
