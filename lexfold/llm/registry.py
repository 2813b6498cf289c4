"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from lexfold.llm import exact_dedup, jaccard_join, kd_clusters, language_id, line_dedup, mixing, packing, pii, quality_rules, secret_scan, simhash_trie, url_filter, vector_codes

QUERIES = {
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op2_url_filter": url_filter.op2_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op7_pii": pii.op7_pii,
    "op9_packing": packing.op9_packing,
    "op10_language_id": language_id.op10_language_id,
    "op11_simhash_trie": simhash_trie.op11_simhash_trie,
    "op12_kd_clusters": kd_clusters.op12_kd_clusters,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op12_kd_clusters": kd_clusters.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
