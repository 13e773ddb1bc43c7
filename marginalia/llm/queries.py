"""Queries of the corpus operators over the whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from marginalia.llm import chosen_path, compact_windows, exact_dedup, line_dedup, media, packing, quality, token_counts, toxicity, word_bpe

QUERIES = {
    "op1_token_attribution": token_counts.op1,
    "op2_mixture_packing": packing.op2,
    "op3_chosen_path_join": chosen_path.op3,
    "op4_toxicity_chain": toxicity.op4,
    "op5_patricia_dedup": exact_dedup.op5,
    "op6_neighbour_quality": quality.op6,
    "op7_bpe_speculate_verify": word_bpe.op7,
    "op8_compact_windows": compact_windows.op8,
    "op9_interleaved_media": media.op9,
    "op10_fuzzy_lines": line_dedup.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op5_patricia_dedup": exact_dedup.ORACLE,
}
