"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from breathline.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

_QUERIES = {
    "op1_warc": op1,
    "op2_exact_dedup": op2,
    "op3_suffix_tree": op3,
    "op4_url_filter": op4,
    "op5_pieces": op5,
    "op6_jaccard_join": op6,
    "op7_decontamination": op7,
    "op8_secrets": op8,
    "op9_toxicity": op9,
    "op10_quality": op10,
}


def queries() -> dict:
    return {name: module.query for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _QUERIES.items() if getattr(module, "SQL", None)}
