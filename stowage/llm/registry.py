"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, histsort, linededup, minhash, packing, pages, paragraphs, rabitq, spacedseed, toxicity

QUERIES = {
    "op1_rotated_codes": rabitq.op1_rotated_codes,
    "op2_block_lstm": pages.op2_block_lstm,
    "op3_histogram_sort": histsort.op3_histogram_sort,
    "op4_heap_bpe": bpe.op4_heap_bpe,
    "op5_paragraph_minhash": paragraphs.op5_paragraph_minhash,
    "op6_ordinal_toxicity": toxicity.op6_ordinal_toxicity,
    "op7_line_chunks": linededup.op7_line_chunks,
    "op8_minhash_inverted_join": minhash.op8_minhash_inverted_join,
    "op9_length_buckets": packing.op9_length_buckets,
    "op10_spaced_seeds": spacedseed.op10_spaced_seeds,
}
#: Others are tested against brute force, round trips or held-out accuracy: SQL can't express them.
ORACLES = {
    "op1_rotated_codes": rabitq.ORACLE,
    "op7_line_chunks": linededup.ORACLE,
    "op8_minhash_inverted_join": minhash.ORACLE,
}
