"""Logical plans and their lowering."""

from .lower import Lowered, lower
from .nodes import Builder, assign, column, constant, function

__all__ = ["Builder", "Lowered", "assign", "column", "constant", "function", "lower"]
