"""Tables by case-insensitive name, with declared column types."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import SqlType


class Table:
    """A stored DataFrame plus the declared types of its columns.

    ``unique`` lists column sets that no two rows share, as the schema says; no
    plan checks it. ``rows`` is counted on first use, and only if asked for.
    """

    def __init__(self, name: str, df: DataFrame, declared: Mapping[str, str], rows: int | None = None, unique: Iterable[Iterable[str]] = ()):
        self.name, self.df = name.lower(), df
        self.unique = tuple(frozenset(u) for u in unique)
        self.columns = {c: SqlType.parse(t) for c, t in declared.items()}
        if missing := set(self.columns) - set(df.columns):
            raise ValueError(f"{name}: no stored column {sorted(missing)}")
        self._rows, self._stored, self._added = rows, df, []

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    def scan(self, columns: Iterable[str], filters: Iterable[Column] = ()) -> DataFrame:
        """Only these columns, each as its declared in-plan type, of the rows
        that pass these filters on the stored columns."""
        stored, df = {f.name: f.dataType for f in self.df.schema}, self.df
        for f in filters:
            df = df.filter(f)
        return df.select(*[self.columns[c].adapt(F.col(c), stored[c]).alias(c) for c in dict.fromkeys(columns)])

    def append(self, rows: Iterable[tuple]) -> "Table":
        """Adds in-memory rows given in the stored column order; however many
        appends there were, the plan has one union."""
        self._added.extend(rows)
        extra = self.df.sparkSession.createDataFrame(self._added, self._stored.schema)
        self.df, self._rows = self._stored.unionByName(extra), None
        return self


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, Table] = {}

    def add(self, name: str, df: DataFrame, declared: Mapping[str, str], rows: int | None = None, unique: Iterable[Iterable[str]] = ()) -> Table:
        if name.lower() in self._tables:
            raise ValueError(f"table {name!r} exists")
        return self._tables.setdefault(name.lower(), Table(name, df, declared, rows, unique))

    def add_rows(self, name: str, rows: Iterable[tuple], declared: Mapping[str, str]) -> Table:
        """Registers an in-memory table; values are given unscaled."""
        types = {c: SqlType.parse(t) for c, t in declared.items()}
        schema = T.StructType([T.StructField(c, t.source, False) for c, t in types.items()])
        data = list(rows)
        return self.add(name, self.spark.createDataFrame(data, schema), declared, len(data))

    def table(self, name: str) -> Table:
        try:
            return self._tables[name.lower()]
        except KeyError:
            raise KeyError(f"unknown table {name!r}") from None

    def names(self) -> list[str]:
        return sorted(self._tables)
