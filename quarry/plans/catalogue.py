"""All queries of the engine, with the SQL each can be compared with."""

from ..functions import queries as _functions  # noqa: F401
from ..operators import catalogue, codes, deliveries, graph, ingest, mutations, navigation, search, tools, upkeep  # noqa: F401
from ..streaming import state  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
