"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, language, line_dedup, near_dedup, packing, quality, substring_dedup, suffix_dedup, vectors

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_top_k_search": vectors.query_top_k,
    "op3_embedding_near_dedup": vectors.query_near,
    "op4_suffix_array_dedup": suffix_dedup.query,
    "op5_line_dedup": line_dedup.query,
    "op6_minhash_near_dedup": near_dedup.query,
    "op7_bpe": bpe.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_packing": packing.query,
    "op10_language_id": language.query,
}
ORACLES: dict[str, str] = {"op2_top_k_search": vectors.SQL_TOP_K, "op5_line_dedup": line_dedup.SQL}
