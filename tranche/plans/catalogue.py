"""All catalogue queries, one per operator, and the SQL that checks them."""

from __future__ import annotations

from tranche.plans import (  # noqa: F401  (importing registers the queries)
    audit_queries,
    cleaning_queries,
    evaluation_queries,
    feature_queries,
    ingest_queries,
    policy_queries,
)
from tranche.plans.registry import CHECKS, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
