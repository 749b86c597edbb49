"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, embeddings, language, lm, mixing, pieces, quality, rules, simhash, tokens


def queries() -> dict:
    return {
        "op1_quality_classifier": quality.op1,
        "op2_simhash_near_dedup": simhash.op2,
        "op3_chat_formatting": chat.op3,
        "op4_token_files": tokens.op4,
        "op5_language_id": language.op5,
        "op6_mixing": mixing.op6,
        "op7_sentencepiece": pieces.op7,
        "op8_quality_rules": rules.op8,
        "op9_embedding_near_dedup": embeddings.op9,
        "op10_lm_scoring": lm.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_formatting": chat.OP3_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op8_quality_rules": rules.OP8_SQL,
        "op9_embedding_near_dedup": embeddings.OP9_SQL,
    }
