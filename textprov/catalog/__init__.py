"""Named queries over the given tables, with check SQL where SQL can say the same."""

from textprov.catalog import batches, fitted, rows, scores, series, strings, tables, tokens
from textprov.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
