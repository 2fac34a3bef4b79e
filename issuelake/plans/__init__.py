"""Queries over the tables, with the SQL that checks them."""

from issuelake.plans import analysis, corpus, records, relational, retrieval, search  # noqa: F401
from issuelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
