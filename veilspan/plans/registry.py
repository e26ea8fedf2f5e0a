"""All queries over the reference's own operators, and their SQL."""

from __future__ import annotations

from . import capture_queries, chain_queries, clinical_queries, corpus_queries, date_queries, file_queries, guard_queries, hook_queries, more_queries, packet_queries, people_queries, record_queries, span_queries
from .base import ORACLE, QUERIES

FLAGSHIP = chain_queries.safe_notes

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES", "capture_queries", "chain_queries", "clinical_queries", "corpus_queries", "date_queries", "file_queries", "guard_queries", "hook_queries", "more_queries", "packet_queries", "people_queries", "record_queries"]
