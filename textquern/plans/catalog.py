"""All queries of the library and, where SQL can express them, their DuckDB twins."""

from textquern.plans import corpus_queries, format_queries, label_queries, learning_queries, more_queries, vector_queries
from textquern.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "corpus_queries", "format_queries", "label_queries", "learning_queries", "more_queries", "vector_queries"]
