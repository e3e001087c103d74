"""The query catalogue: importing this package registers every query."""

from . import cubes_and_measures, learning, models, preparing, searching, texts, warehouse  # noqa: F401
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "query"]
