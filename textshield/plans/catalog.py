"""All registered queries."""

from textshield.plans import (  # noqa: F401  importing a module registers its queries
    corpus_queries,
    evaluation_queries,
    retrieval_queries,
    screening_queries,
    source_queries,
    text_queries,
)
from textshield.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
