"""Imports every module that registers queries."""

from gleaner.plans import (  # noqa: F401
    call_plans,
    document_plans,
    enrichment_plans,
    evaluation_plans,
    retrieval_plans,
    table_plans,
    usage_plans,
)
