"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from scenewright.llm import bpe, decontaminate, exact_dedup, language, ngram_join, preference, quality, sentence_spans, token_counts, training_order

QUERIES = {
    "op3_training_order": training_order.op3_training_order,
    "op5_sentence_spans": sentence_spans.op5_sentence_spans,
    "op2_token_counts": token_counts.op2_token_counts,
    "op9_preference_format": preference.op9_preference_format,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op8_ngram_jaccard": ngram_join.op8_ngram_jaccard,
    "op1_quality_neighbours": quality.op1_quality_neighbours,
    "op4_language_mixture": language.op4_language_mixture,
    "op7_bpe": bpe.op7_bpe,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {
    "op9_preference_format": preference.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
