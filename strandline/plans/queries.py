"""All registered queries."""

from strandline.plans import catalog_queries, text_queries, vector_queries
from strandline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "catalog_queries", "text_queries", "vector_queries"]
