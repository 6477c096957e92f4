"""All registered queries and their SQL twins."""

from fleetsight.registry import features, models, round_trips, series, sketched, sql_functions, streams  # noqa: F401  (they register themselves)
from fleetsight.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
