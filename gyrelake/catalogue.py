"""All queries of the library but those of the llm subpackage."""

from gyrelake import placement_queries, queries, raster_queries, solver_queries
from gyrelake.registry import ORACLE_SQL, QUERIES

FLAGSHIP = queries.FLAGSHIP

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "placement_queries", "queries", "raster_queries", "solver_queries"]
