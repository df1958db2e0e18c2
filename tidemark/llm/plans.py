"""Registered corpus queries and their DuckDB texts; a query without one is tested against a brute-force version."""
from __future__ import annotations

from tidemark.llm import (
    decontaminate, embedding_groups, line_dedup, mixing, ordinal_quality, packing, periodic_runs, prefix_trie, pseudonyms, suffix_array, superminhash,
    token_counts, url_rules,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_mixing": mixing.op3_mixing,
    "op4_url_rules": url_rules.op4_url_rules,
    "op5_feistel_pseudonyms": pseudonyms.op5_feistel_pseudonyms,
    "op6_repeated_passages": suffix_array.op6_repeated_passages,
    "op7_embedding_groups": embedding_groups.op7_embedding_groups,
    "op8_superminhash": superminhash.op8_superminhash,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_ordinal_quality": ordinal_quality.op10_ordinal_quality,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_packing": packing.op13_packing,
}
SQL = {
    "op2_benchmark_decontamination": decontaminate.SQL,
    "op3_mixing": mixing.SQL,
    "op4_url_rules": url_rules.SQL,
    "op7_embedding_groups": embedding_groups.SQL,
    "op8_superminhash": superminhash.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
