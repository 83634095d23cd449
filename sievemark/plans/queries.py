"""All queries of the reference's own operators."""

from . import billing, operations, regions, reports, review, signals, stores, texts, web  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
