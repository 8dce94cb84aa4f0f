"""Hash aggregation forms. Spark pre-aggregates before each exchange."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(df: DataFrame, keys: Sequence[str], payloads: Sequence[str], aggs: Sequence[Column], determined: Collection[str] = ()) -> DataFrame:
    """Keys, then carried payload columns, then aggregates.

    Payloads depend on the keys. Those known to be ``determined`` by them are
    keys as well, so that strings are hashed; of the others ``min`` picks the
    value and stays deterministic if they do not depend on the keys.
    """
    names = list(dict.fromkeys(keys))
    payloads = [c for c in dict.fromkeys(payloads) if c not in names]
    if not payloads and not aggs:
        return distinct_keys(df, names)
    hashed = [c for c in payloads if c in determined]
    carried = [F.min(c).alias(c) for c in payloads if c not in determined]
    if not carried and not aggs:
        return distinct_keys(df, [*names, *hashed]).select(*names, *payloads)
    out = df.groupBy(*names, *hashed).agg(*carried, *aggs)
    rest = [c for c in out.columns if c not in (*names, *payloads)]
    return out.select(*names, *payloads, *rest)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*dict.fromkeys(keys)).distinct()


def global_aggregate(df: DataFrame, aggs: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """One row, or none if there are no input rows."""
    return df.agg(*aggs, F.count(F.lit(1)).alias("__rows")).filter("__rows > 0").select(*names)
