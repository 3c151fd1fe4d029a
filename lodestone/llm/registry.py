"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import contamination, fingerprint, neardup, phrases, pieces, quality, runindex, sharding, tokencount, toxicity

_MODULES = {
    "op1_simhash": neardup,
    "op2_suffix_dedup": runindex,
    "op3_decontamination": contamination,
    "op4_toxicity": toxicity,
    "op5_sentencepiece": pieces,
    "op6_fingerprints": fingerprint,
    "op7_sharding": sharding,
    "op8_token_counts": tokencount,
    "op9_quality": quality,
    "op10_phrase_dedup": phrases,
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE_SQL for name, m in _MODULES.items() if m.ORACLE_SQL}
