"""All queries of the library."""

from . import archive_queries, ordered_queries, parsing_queries, raster_queries, rule_queries, scalar_queries, shape_queries, sound_queries, timing_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
