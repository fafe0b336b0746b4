"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemill.llm import (
    chat_format,
    jaccard_join,
    mixing,
    packing,
    pseudo_likelihood,
    quality_classifier,
    quality_rules,
    substring_dedup,
    vector_tree,
    warc_fixity,
)

QUERIES = {
    "op1_pseudo_likelihood": pseudo_likelihood.op1_pseudo_likelihood,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_sequence_packing": packing.op3_sequence_packing,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
    "op6_vector_tree": vector_tree.op6_vector_tree,
    "op7_warc_fixity": warc_fixity.op7_warc_fixity,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
}

SQL: dict[str, str] = {
    "op4_quality_rules": quality_rules.SQL,
    "op7_warc_fixity": warc_fixity.SQL,
    "op8_chat_format": chat_format.SQL,
}
