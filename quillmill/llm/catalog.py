"""All training-data queries and their SQL."""

from __future__ import annotations

from quillmill.llm import (  # noqa: F401  (importing files the queries)
    cutoffs,
    leakage,
    neardup,
    overlap,
    packing,
    pairs,
    residue,
    splits,
    truncation,
)
from quillmill.llm.registry import REGISTRY


def queries() -> dict:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in REGISTRY.items() if s}
