"""Old/new table pairs derived from the test tables, the registered queries and their SQL."""

from checks import audits, columns, differences, investigations, validators  # noqa: F401
from checks.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
