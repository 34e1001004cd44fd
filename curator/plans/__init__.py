"""Queries by area; importing this package registers them."""

from . import curation, feed, files, incremental, lists, more, safety, scoring, state  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
