"""The registered queries, their DuckDB twins, and jobs made of operators."""

from . import changes, graphs, markdown, pages, sources  # noqa: F401
from .pages import flagship
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
