"""Registered queries over the test tables."""

from docloom.workloads import clinical, health, highlights, lexical, pages, reports, rerank, streams, structure  # noqa: F401
from docloom.workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
