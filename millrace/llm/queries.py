"""Queries and SQL oracles of the corpus operators."""

from __future__ import annotations

from millrace.llm import exact_dedup, fingerprint, html_extract, jaccard_join, license_scan, mixing, packing, quality, secrets, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_quality": quality.op5_quality,
    "op6_packing": packing.op6_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_fingerprints": fingerprint.op9_fingerprints,
    "op10_secret_scan": secrets.op10_secret_scan,
}
ORACLES = {"op2_license_scan": license_scan.SQL, "op7_mixing": mixing.SQL, "op8_exact_dedup": exact_dedup.SQL}
