"""Registered queries over the given tables, each with its equivalent SQL."""

from gustline.plans import audits, exports, files, histories, joins, records, streams, summaries, times  # noqa: F401
from gustline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
