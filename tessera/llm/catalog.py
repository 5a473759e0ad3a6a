"""The subpackage's queries and their SQL equivalents."""

from __future__ import annotations

from . import chunk_dedup, conversations, fingerprints, packing, quality_rules, secrets, sentence_pieces, shingle_join, suffix_dedup, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_chat_snapshots": conversations.op2_chat_snapshots,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_i_match": fingerprints.op5_i_match,
    "op6_shingle_join": shingle_join.op6_shingle_join,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_chunk_dedup": chunk_dedup.op9_chunk_dedup,
    "op10_sentence_pieces": sentence_pieces.op10_sentence_pieces,
    "quality_base": quality_rules.quality_base,
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op2_chat_snapshots": conversations.ORACLE,
    "op6_shingle_join": shingle_join.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "quality_base": quality_rules.ORACLE_BASE,
}
