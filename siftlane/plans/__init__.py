"""Ready-made queries over the driver tables, and their SQL counterparts."""

from siftlane.plans.oracles import ORACLES
from siftlane.plans import feeds  # noqa: F401  registers its queries
from siftlane.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
