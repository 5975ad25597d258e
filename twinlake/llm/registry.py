"""Queries and oracle SQL of this package, by name."""

from __future__ import annotations

from . import exact_dedup, html_extract, licenses, merkle, mixing, ngram_join, packing, quality, secret_scan, sharding, token_count, toxicity, whitening

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_toxicity": toxicity.op2,
    "op3_sharding": sharding.op3,
    "op4_quality_rules": quality.op4,
    "op5_license_scan": licenses.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_packing": packing.op7,
    "op8_token_counts": token_count.op8,
    "op9_ngram_join": ngram_join.op9,
    "op10_secret_scan": secret_scan.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_whitening": whitening.op12,
    "op13_html_extraction": html_extract.op13,
}

ORACLE = {
    "op1_mixing": mixing.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
}
