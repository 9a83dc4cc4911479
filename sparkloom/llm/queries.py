"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: query name -> module of this subpackage
MODULES = {
    "op2_packing": "packing",
    "op6_fingerprints": "fingerprints",
    "op8_suffix_array_dedup": "repeats",
    "op10_jaccard_join": "jaccard",
    "op1_toxicity": "toxicity",
    "op9_quality": "quality",
    "op3_token_counts": "token_counts",
    "op4_html_extraction": "wrapper",
    "op5_warc": "warc",
    "op7_benchmark_decontamination": "decontaminate",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"sparkloom.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        if sql := getattr(importlib.import_module(f"sparkloom.llm.{module}"), "ORACLE_SQL", None):
            found[name] = sql
    return found
