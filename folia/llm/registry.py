"""Queries and SQL of this package, by the names that the entry point registers."""

from __future__ import annotations

from folia.llm import bisector_clusters, conversation_repair, decontaminate, exact_dedup, html_text, license_scan, line_dedup, ngram_score, personal_data, repetition, sampled_pieces, sharding, simhash

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_decontaminate": decontaminate.query,
    "op3_sharding": sharding.query,
    "op4_repetition": repetition.query,
    "op5_line_dedup": line_dedup.query,
    "op6_simhash": simhash.query,
    "op7_personal_data": personal_data.query,
    "op8_sampled_pieces": sampled_pieces.query,
    "op9_html_text": html_text.query,
    "op10_ngram_score": ngram_score.query,
    "op11_bisector_clusters": bisector_clusters.query,
    "op12_exact_dedup": exact_dedup.query,
    "op13_conversation_repair": conversation_repair.query,
}
#: The other queries need XXH64, suffix arrays, sampling or trained models; tests hold them against plain Python.
SQL = {
    "op1_license_scan": license_scan.SQL, "op3_sharding": sharding.SQL, "op5_line_dedup": line_dedup.SQL, "op11_bisector_clusters": bisector_clusters.SQL,
    "op12_exact_dedup": exact_dedup.SQL, "op13_conversation_repair": conversation_repair.SQL,
}
