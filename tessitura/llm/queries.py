"""Queries and SQL of this subpackage's operators, as __spark_entry__ registers them."""

from __future__ import annotations

from tessitura.llm import chat, exact, langid, minhash, mixing, packing, quality_classifier, quality_rules, substring, urlfilter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_pack": packing.op2_pack,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_language_id": langid.op4_language_id,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_near_dedup": minhash.op7_near_dedup,
    "op8_chat_format": chat.op8_chat_format,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_exact_dedup": exact.op10_exact_dedup,
}
ORACLES = {"op8_chat_format": chat.OP8_SQL, "op9_url_filter": urlfilter.OP9_SQL, "op10_exact_dedup": exact.OP10_SQL}
