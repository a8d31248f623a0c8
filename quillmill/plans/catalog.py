"""All core queries and their SQL."""

from __future__ import annotations

from quillmill.plans import filtering, ingesting, joining, judging, measuring, reshaping, sampling, texts  # noqa: F401  (importing files the queries)
from quillmill.plans.registry import REGISTRY


def queries() -> dict:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in REGISTRY.items() if s}
