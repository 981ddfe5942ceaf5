"""Queries over the given tables, each beside the SQL that must give the same rows."""

from checks.registry import ORACLES, QUERIES
from checks import acquisition, lattices, raster, zones  # noqa: F401
