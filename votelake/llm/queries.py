"""Registered queries of this sub-package and their DuckDB SQL."""

from __future__ import annotations

from votelake.llm import bpe, exact_dedup, licenses, line_dedup, media, mixing, pii, sharding, simhash, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_media": media.query,
    "op3_pii": pii.query,
    "op4_sharding": sharding.query,
    "op5_mixing": mixing.query,
    "op6_bpe": bpe.query,
    "op7_licenses": licenses.query,
    "op8_line_dedup": line_dedup.query,
    "op9_toxicity": toxicity.query,
    "op10_simhash": simhash.query,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_sharding": sharding.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
}
