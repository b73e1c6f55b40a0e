"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import (
    op01_spotsigs, op02_warc, op03_substring_dedup, op04_quality, op05_url_filter, op06_embedding_dedup, op07_jaccard_join,
    op08_sentencepiece, op09_interleave, op10_packing,
)

QUERIES = {
    "op1_spotsigs": op01_spotsigs.op1_spotsigs,
    "op2_warc": op02_warc.op2_warc,
    "op3_substring_dedup": op03_substring_dedup.op3_substring_dedup,
    "op4_quality": op04_quality.op4_quality,
    "op5_url_filter": op05_url_filter.op5_url_filter,
    "op6_embedding_dedup": op06_embedding_dedup.op6_embedding_dedup,
    "op7_jaccard_join": op07_jaccard_join.op7_jaccard_join,
    "op8_sentencepiece": op08_sentencepiece.op8_sentencepiece,
    "op9_interleave": op09_interleave.op9_interleave,
    "op10_hilbert_packing": op10_packing.op10_hilbert_packing,
}

ORACLES = {
    "op1_spotsigs": op01_spotsigs.OP1_SQL,
    "op2_warc": op02_warc.OP2_SQL,
    "op6_embedding_dedup": op06_embedding_dedup.OP6_SQL,
    "op7_jaccard_join": op07_jaccard_join.OP7_SQL,
    "op9_interleave": op09_interleave.OP9_SQL,
}
