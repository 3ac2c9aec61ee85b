"""Named queries over the given tables, one module per area."""

from assaylake.plans.registry import ORACLES, QUERIES
from assaylake.plans import cleaning, clustering, joins, profiling, regression, reports, sources, splits, statistics  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
