"""Whole evaluation plans and the registered queries."""

from gavel.plans import (  # noqa: F401
    board_queries,
    corpus_queries,
    io_queries,
    item_queries,
    metric_queries,
    scoring_queries,
)
from gavel.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
