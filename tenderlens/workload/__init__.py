"""Queries over the driver tables with their SQL checks."""

from tenderlens.workload import ingest, market, news, quality  # noqa: F401  (they register queries)
from tenderlens.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
