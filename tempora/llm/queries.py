"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tempora.llm import chat, decontaminate, exact_dedup, filter_audit, html_text, language, mixing, ngram_join, packing, substrings, topk, vector_codes, warc

QUERIES = {
    "op1_host_suffix_array": html_text.op1_host_suffix_array,
    "op2_blockwise_suffixes": substrings.op2_blockwise_suffixes,
    "op3_viterbi": language.op3_viterbi,
    "op4_cost_balanced": packing.op4_cost_balanced,
    "op5_event_sourced": chat.op5_event_sourced,
    "op6_content_sort": exact_dedup.op6_content_sort,
    "op7_salvage": warc.op7_salvage,
    "op8_pareto_mix": mixing.op8_pareto_mix,
    "op9_pivot_distance": topk.op9_pivot_distance,
    "op10_grouped_prefix": ngram_join.op10_grouped_prefix,
    "op11_positional_index": decontaminate.op11_positional_index,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_kd_codes": vector_codes.op13_kd_codes,
}

ORACLE_SQL = {
    "op10_grouped_prefix": ngram_join.OP10_SQL,
    "op11_positional_index": decontaminate.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_kd_codes": vector_codes.OP13_SQL,
    "op5_event_sourced": chat.OP5_SQL,
    "op6_content_sort": exact_dedup.OP6_SQL,
    "op9_pivot_distance": topk.OP9_SQL,
}
