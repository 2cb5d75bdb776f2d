"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from loomgraph.llm import decontaminate, html_text, language_id, line_dedup, lm_scoring, mixing, ngram_join, quality_classifier, quality_rules, suffix_dedup

QUERIES = {
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op4_html_text": html_text.op4_html_text,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op7_language_id": language_id.op7_language_id,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES = {
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op8_ngram_join": ngram_join.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
