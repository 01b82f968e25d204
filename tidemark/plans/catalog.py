"""Imports every query module so that the registry is complete."""

from tidemark.plans import q_books, q_outcomes, q_runs, q_signals, q_sources, q_time, q_value  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
