"""The queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

from graphspark.llm import ann, exact_dedup, jaccard_join, language_id, line_dedup, mixing, packing, substring_dedup, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_toxicity": toxicity.query,
    "op3_language_id": language_id.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_warc": warc.query,
    "op7_packing": packing.query,
    "op8_mixing": mixing.query,
    "op9_ann": ann.query,
    "op10_line_dedup": line_dedup.query,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op6_warc": warc.SQL,
    "op8_mixing": mixing.SQL,
}
