"""The queries of this subpackage and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

import corpus_pipeline
from lithoscope.llm import bpe, chat, language, merkle, packing, simhash, substring, topk, toxicity, urls

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_url_filter": urls.op3_url_filter,
    "op4_language_id": language.op4_language_id,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_simhash": simhash.op6_simhash,
    "op7_packing": packing.op7_packing,
    "op8_chat_format": chat.op8_chat_format,
    "op9_fingerprints": merkle.op9_fingerprints,
    "op10_exact_topk": topk.op10_exact_topk,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op2_substring_dedup": substring.OP2_SQL, "op3_url_filter": urls.OP3_SQL, "op8_chat_format": chat.OP8_SQL, "op9_fingerprints": merkle.OP9_SQL, "op10_exact_topk": topk.OP10_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
