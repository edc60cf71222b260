"""The registered queries of this subpackage and their DuckDB partners."""

from __future__ import annotations

from riskmart.llm import chat, decontaminate, forest, infill, lines, near, pieces, quality, resample, tokens, toxicity, urls, vptree

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_ngram_jaccard_join": near.op2_ngram_jaccard_join,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_vp_tree": vptree.op6_vp_tree,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_url_filters": urls.op8_url_filters,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_lsh_forest": forest.op11_lsh_forest,
    "op12_importance_resampling": resample.op12_importance_resampling,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

SQL = {
    "op1_chat_formatting": chat.SQL1,
    "op7_line_dedup": lines.SQL7,
    "op8_url_filters": urls.SQL8,
    "op13_fill_in_middle": infill.SQL13,
}
