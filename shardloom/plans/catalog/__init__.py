"""All registered queries, one per operator of the blueprint."""

from . import functions, joins, positions, projections, sources, streams, summaries  # noqa: F401
from .common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
