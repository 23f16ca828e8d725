"""Named queries: the operators bound to the tables of a data folder, each with its SQL twin."""

from . import aggregates, features, joins, kernels, quality, scalars, sequences  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
