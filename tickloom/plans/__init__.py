"""Registered queries: importing the modules fills the registry."""

from tickloom.plans import (  # noqa: F401
    bar_queries,
    history_queries,
    scalars,
    scans,
    stream_queries,
    tick_queries,
    validation,
)
from tickloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
