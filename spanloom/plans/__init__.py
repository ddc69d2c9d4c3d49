"""All queries of the library but those of the llm subpackage."""

from __future__ import annotations

from spanloom.plans import added, analytics, detection, entities, more, texts


def all_queries() -> dict:
    """name: (query, SQL that gives the same rows, or None)."""
    return detection.QUERIES | entities.QUERIES | analytics.QUERIES | texts.QUERIES | more.QUERIES | added.QUERIES
