"""File sources."""

from .delimited import append_rows, load_delimited, write_delimited
from .parquet import load_star_schema

__all__ = ["append_rows", "load_delimited", "load_star_schema", "write_delimited"]
