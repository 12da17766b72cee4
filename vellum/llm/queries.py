"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from vellum.llm import brown_lm, embedding_caps, mixing, quality_rules, sentencepiece_scan, simhash, suffix_dedup, url_filters, warc, wavelet

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_brown_lm": brown_lm.op2_brown_lm,
    "op3_mixing": mixing.op3_mixing,
    "op4_warc": warc.op4_warc,
    "op5_sentencepiece_scan": sentencepiece_scan.op5_sentencepiece_scan,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_token_ids": wavelet.op7_token_ids,
    "op8_simhash": simhash.op8_simhash,
    "op9_embedding_caps": embedding_caps.op9_embedding_caps,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLES = {
    "op1_url_filters": url_filters.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
    "op9_embedding_caps": embedding_caps.OP9_SQL,
}
