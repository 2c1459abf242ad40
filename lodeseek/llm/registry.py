"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, chat, langid, minhash, packing, quality, substrings, subword, topk, warc

QUERIES = {
    "op1_language_id": langid.query,
    "op2_minhash_near_dedup": minhash.query,
    "op3_exact_top_k": topk.query,
    "op4_quality_classifier": quality.query,
    "op5_sentencepiece": subword.query,
    "op6_packing": packing.query,
    "op7_warc": warc.query,
    "op8_substring_dedup": substrings.query,
    "op9_nearest_neighbours": ann.query,
    "op10_chat_formatting": chat.query,
}
ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": minhash.ORACLE,
    "op3_exact_top_k": topk.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_substring_dedup": substrings.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
}
