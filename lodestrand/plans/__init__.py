"""Importing this package registers every query."""

from lodestrand.plans import arrivals, assembly, globe, places, planning, queries, reading, replies, sources, stories, worldview  # noqa: F401
from lodestrand.plans.registry import ORACLE, QUERIES  # noqa: F401
