"""Multi-key ordering and its truncated form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _order(keys: Sequence[tuple[str, bool]]):
    return [F.col(c).asc() if ascending else F.col(c).desc() for c, ascending in keys]


def sort(df: DataFrame, keys: Sequence[tuple[str, bool]], within_partitions: bool = False) -> DataFrame:
    """Rows by (column, ascending) keys: a range exchange and local sorts."""
    return df.sortWithinPartitions(*_order(keys)) if within_partitions else df.orderBy(*_order(keys))


def top(df: DataFrame, keys: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """The first ``n`` rows of that order, without sorting the rest."""
    return df.orderBy(*_order(keys)).limit(n)
