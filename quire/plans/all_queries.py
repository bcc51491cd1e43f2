"""All queries of the engine."""

from quire.plans import dimension_queries, docx_queries, file_queries, more_queries, outline_queries, pattern_queries, reference_queries, storage_queries, style_queries, text_queries  # noqa: F401  register
from quire.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
