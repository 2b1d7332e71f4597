"""The registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pulsegrid.llm import (
    decontamination, language_id, license_scan, packing, periodic_runs, quality_rules, simhash_dedup, substring_dedup, token_counts, toxicity, url_filters,
    vector_codes, warc,
)

QUERIES = {
    "op1_license_scans": license_scan.query,
    "op2_warc": warc.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_simhash_near_dedup": simhash_dedup.query,
    "op6_quality_rules": quality_rules.query,
    "op7_mixture_packing": packing.query,
    "op8_url_filters": url_filters.query,
    "op9_benchmark_decontamination": decontamination.query,
    "op10_language_id": language_id.query,
    "op11_vector_codes": vector_codes.query,
    "op12_token_counts": token_counts.query,
    "op13_periodic_runs": periodic_runs.query,
}

SQL = {
    "op8_url_filters": url_filters.SQL,
    "op11_vector_codes": vector_codes.SQL,
}
