"""The queries of the engine's own operators."""

from . import citations, graphs, identities, provisions, relational, retrieval, rollups, services  # noqa: F401  (they register themselves)
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
