"""Imports every query module so that the registry is complete."""

from judgelake.plans import (  # noqa: F401
    queries_compare,
    queries_compose,
    queries_corpus,
    queries_evaluate,
    queries_inputs,
    queries_judging,
    queries_packaging,
    queries_scalars,
    queries_sources,
    queries_sweep,
    queries_units,
)
from judgelake.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
