"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from packetloom.llm import decontaminate, exact_dedup, filter_audit, fm_index, html_consensus, jaccard_join, language_crf, packing, pivot_search, prefix_trie, quote_links, suffix_arrays, url_templates

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_language_id": language_crf.op3_language_id,
    "op4_packing": packing.op4_packing,
    "op5_quotation_linking": quote_links.op5_quotation_linking,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_substring_dedup": fm_index.op7_substring_dedup,
    "op8_suffix_array_dedup": suffix_arrays.op8_suffix_array_dedup,
    "op9_html_extraction": html_consensus.op9_html_extraction,
    "op10_url_filters": url_templates.op10_url_filters,
    "op11_filter_interaction_audit": filter_audit.op11_filter_interaction_audit,
    "op12_conversation_prefix_trie": prefix_trie.op12_conversation_prefix_trie,
    "op13_exact_topk_search": pivot_search.op13_exact_topk_search,
}
ORACLE = {
    "op1_ngram_jaccard_join": jaccard_join.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_quotation_linking": quote_links.SQL,
    "op6_benchmark_decontamination": decontaminate.SQL,
    "op7_substring_dedup": fm_index.SQL,
    "op11_filter_interaction_audit": filter_audit.SQL,
    "op12_conversation_prefix_trie": prefix_trie.SQL,
    "op13_exact_topk_search": pivot_search.SQL,
}
