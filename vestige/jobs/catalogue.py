"""All registered queries that aren't of the language-model subpackage."""

from __future__ import annotations

from vestige.jobs import event_queries, join_queries, more_queries, payload_queries, record_queries, report_queries, text_queries, view_queries  # noqa: F401  each module registers its own
from vestige.jobs.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
