"""Gazette monitoring on Spark: select editions, search them, cut out legal acts, report."""

from gazewatch.plans.runs import backfill, run
from gazewatch.plans.search import find_matches, find_matches_in_documents
from gazewatch.sources.rules import FilterRule, rules_frame

__all__ = [
    "FilterRule",
    "backfill",
    "find_matches",
    "find_matches_in_documents",
    "rules_frame",
    "run",
]
