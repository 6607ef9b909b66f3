"""All queries of the paged-table operators."""

from quire.plans import files, lookups, numeric, ordering, selection, statistics  # noqa: F401
from quire.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
