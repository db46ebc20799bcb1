"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import decontaminate, html_text, jaccard_join, language_id, metric_join, packing, sharding, suffix_dedup, token_table, url_filter

QUERIES = {
    "op1_jaccard_join": jaccard_join.query,
    "op2_language_id": language_id.query,
    "op3_decontaminate": decontaminate.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_token_table": token_table.query,
    "op6_url_filter": url_filter.query,
    "op7_packing": packing.query,
    "op8_metric_join": metric_join.query,
    "op9_sharding": sharding.query,
    "op10_html_text": html_text.query,
}

ORACLES = {
    "op1_jaccard_join": jaccard_join.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op8_metric_join": metric_join.ORACLE,
    "op9_sharding": sharding.ORACLE,
}
