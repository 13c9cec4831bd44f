"""The queries of this package and the SQL they are held against."""

from skylattice.llm import conversation_trie, decontamination, embedding_dedup, html_extraction, line_dedup, lm_scoring, mixing, ngram_join, quality, substring_dedup, token_output, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_output": token_output.op6_token_output,
    "op7_decontamination": decontamination.op7_decontamination,
    "op10_quality": quality.op10_quality,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op11_conversation_trie": conversation_trie.op11_conversation_trie,
    "op12_html_extraction": html_extraction.op12_html_extraction,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_embedding_dedup": embedding_dedup.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_conversation_trie": conversation_trie.ORACLE,
}
