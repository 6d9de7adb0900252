"""Every query of the library by name, with its DuckDB SQL."""

from . import catalog, documents, overlaps, papers, replies, segments, streams, upkeep, work  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
