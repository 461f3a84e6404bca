"""All registered queries and their DuckDB texts."""

from ledgerlark.catalog import evaluation, graphs, history, inputs, models  # noqa: F401
from ledgerlark.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
