"""Queries of the corpus operators over their whole tables, and their SQL."""

from __future__ import annotations

from tessera.llm import chat_format, decontaminate, exact_dedup, lang_id, lm_score, mixing, secret_scan, simhash_dedup, token_binary, toxicity

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_lm_score": lm_score.query,
    "op4_token_binary": token_binary.query,
    "op5_decontaminate": decontaminate.query,
    "op6_lang_id": lang_id.query,
    "op7_toxicity": toxicity.query,
    "op8_chat_format": chat_format.query,
    "op9_mix_sources": mixing.query,
    "op10_simhash_dedup": simhash_dedup.query,
}
ORACLES = {
    "op1_secret_scan": secret_scan.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op8_chat_format": chat_format.SQL,
}
