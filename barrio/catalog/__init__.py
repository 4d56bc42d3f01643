"""Registered queries, each over the test tables, with the SQL they are checked against."""

from barrio.catalog.registry import ORACLES, QUERIES, load

__all__ = ["ORACLES", "QUERIES", "load"]
