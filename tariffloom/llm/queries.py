"""The registered queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tariffloom.llm import alignment, conversations, decontamination, html_extraction, jaccard, language, mixing, quality, secrets, simhash, suffixes, tokens, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_mixing": mixing.op2_mixing,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_language_id": language.op10_language_id,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_simhash": simhash.op13_simhash,
}

SQL = {
    "op2_mixing": mixing.SQL,
    "op6_quality_rules": quality.SQL,
}
