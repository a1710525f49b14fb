"""Registered queries; importing the package registers all of them."""

from codeloom.plans import code_queries, graph_queries, more_queries, service_queries, vector_queries
from codeloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "code_queries", "graph_queries", "more_queries", "service_queries", "vector_queries"]
