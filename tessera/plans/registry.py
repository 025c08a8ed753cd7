"""Registered queries of the library's own operators, and the SQL each is held against."""

from . import function_queries, graph_queries, grouping_queries, interval_queries, path_queries, repo_queries, text_queries, tree_queries, whole_queries  # noqa: F401  they register
from .base import ORACLE_SQL, QUERIES  # noqa: F401
