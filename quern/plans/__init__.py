"""Queries over the standard tables, with their SQL counterparts."""

from . import answers, context, quality, records, relations, reports, review, scripts, story, structure, usage, vectors, verbs  # noqa: F401
from .book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
