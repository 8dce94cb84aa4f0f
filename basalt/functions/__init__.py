"""Scalar and aggregate function library."""

from .registry import AGGREGATES, SCALARS, register_scalar

__all__ = ["AGGREGATES", "SCALARS", "register_scalar"]
