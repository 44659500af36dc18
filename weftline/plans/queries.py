"""All lineage queries."""

from weftline.plans import control_queries, edge_queries, more_queries, names_queries, nightly_queries, source_queries  # noqa: F401
from weftline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
