"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from corvane.llm import chat_format, content_sort, decontaminate, filter_audit, hidden_markov, periodic_runs, quality, simhash, source_mix, token_counts, token_shards, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_language_model": hidden_markov.op3_language_model,
    "op4_simhash": simhash.op4_simhash,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_exact_dedup": content_sort.op7_exact_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_source_mix": source_mix.op9_source_mix,
    "op10_token_shards": token_shards.op10_token_shards,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_chat_format": chat_format.op12_chat_format,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op7_exact_dedup": content_sort.SQL,
    "op9_source_mix": source_mix.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_chat_format": chat_format.SQL,
}
