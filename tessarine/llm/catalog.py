"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from tessarine.llm import chat, decontaminate, hmm, html_text, language_id, mixing, ngram_join, ogg, secrets, toxicity

QUERIES = {
    "op1_ngram_jaccard": ngram_join.query,
    "op2_hmm_scores": hmm.query,
    "op3_decontaminate": decontaminate.query,
    "op4_secret_scan": secrets.query,
    "op5_source_mixing": mixing.query,
    "op6_html_text": html_text.query,
    "op7_ogg_media": ogg.query,
    "op8_chat_format": chat.query,
    "op9_language_id": language_id.query,
    "op10_toxicity": toxicity.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": ngram_join.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op5_source_mixing": mixing.SQL,
    "op7_ogg_media": ogg.SQL,
}
