"""Queries over the test tables; importing this package fills the registry."""

from . import check_queries, profile_queries, transform_queries, analysis_queries, catalog_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
