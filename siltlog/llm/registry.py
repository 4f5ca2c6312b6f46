"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from siltlog.llm import bpe, brown, interactions, lines, neardup, packing, passages, phrases, quality, rules, urls, vectors, warc

QUERIES = {
    "op1_pack_sequences": packing.op1_pack_sequences,
    "op2_url_filter": urls.op2_url_filter,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_quality_rules": rules.op4_quality_rules,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_minhash_dedup": neardup.op6_minhash_dedup,
    "op7_vector_dedup": vectors.op7_vector_dedup,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_warc": warc.op9_warc,
    "op10_class_lm": brown.op10_class_lm,
    "op11_rlz_passages": passages.op11_rlz_passages,
    "op12_filter_audit": interactions.op12_filter_audit,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE: dict[str, str] = {
    "op2_url_filter": urls.OP2_SQL,
    "op4_quality_rules": rules.OP4_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_rlz_passages": passages.OP11_SQL,
    "op12_filter_audit": interactions.OP12_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
