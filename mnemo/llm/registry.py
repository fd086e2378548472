"""The queries of this subpackage and their DuckDB SQL, for __spark_entry__.py."""

from __future__ import annotations

from mnemo.llm import exact_dedup, html_text, language_model, mixing, near_join, quality, sampled_pieces, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_lm_scoring": language_model.op4_lm_scoring,
    "op5_ngram_jaccard_join": near_join.op5_ngram_jaccard_join,
    "op10_sentencepiece": sampled_pieces.op10_sentencepiece,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_mixing": mixing.op9_mixing,
}

#: The others have no SQL: suffix sorting, learned scores, rendering, tokenizers and seeded draws; their tests are brute force.
ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op5_ngram_jaccard_join": near_join.ORACLE,
    "op8_quality_rules": quality.oracle(),
}
