"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

_NAMES = {
    "op1_token_files": "token_files",
    "op2_jaccard_join": "near_copies",
    "op3_hamming_search": "hamming",
    "op4_substring_dedup": "repeats",
    "op5_secret_scan": "secrets",
    "op6_context_tree": "context_tree",
    "op7_hash_forest": "hash_forest",
    "op8_mixing": "mixing",
    "op9_packing": "packing",
    "op10_language_id": "language_id",
    "op11_bpe_tree": "bpe_tree",
    "op12_periodic_runs": "periodic",
    "op13_ranked_search": "ranking",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"sluicework.llm.{module}"), name) for name, module in _NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module in sorted(set(_NAMES.values())):
        found |= getattr(importlib.import_module(f"sluicework.llm.{module}"), "ORACLE_SQL", {})
    return found
