"""Declared column types: SQL text -> Spark type, decimal scale and value domain.

The data model is integer centred: a ``decimal(p,s)`` is a whole number of
10^-s units, a date is a date, and there are no NULLs, floats or booleans.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The declared integer types and their widths in bits.
_INTEGERS = {
    "bigint": 64, "i64": 64,
    "integer": 32, "int": 32, "i32": 32,
    "smallint": 16, "i16": 16,
    "tinyint": 8, "i8": 8,
}
_SPARK_INT = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}
#: Days between the Julian Day Number epoch and 1970-01-01.
JULIAN_OFFSET = 2440588


@dataclass(frozen=True)
class SqlType:
    """A declared type. ``kind`` is one of int, decimal, date, text, char1."""

    kind: str
    bits: int = 64
    precision: int = 0
    scale: int = 0

    @classmethod
    def parse(cls, text: str) -> "SqlType":
        t = re.sub(r"\s+", "", text.lower())
        if t in _INTEGERS:
            return cls("int", bits=_INTEGERS[t])
        if t == "date":
            return cls("date", bits=32)
        if t in ("text", "varchar"):
            return cls("text")
        if m := re.fullmatch(r"(varchar|char)\((\d+)\)", t):
            return cls("char1", bits=8) if m[1] == "char" and m[2] == "1" else cls("text")
        if m := re.fullmatch(r"decimal\((\d+)(?:,(\d+))?\)", t):
            precision, scale = int(m[1]), int(m[2] or 0)
            if scale > precision:
                raise ValueError(f"scale exceeds precision in {text!r}")
            return cls("decimal", _bits_for(10**precision), precision, scale)
        raise ValueError(f"unknown SQL type {text!r}")

    @property
    def spark(self) -> T.DataType:
        """Type of the column inside a plan (decimals as scaled units)."""
        if self.kind == "int":
            return _SPARK_INT[self.bits]
        if self.kind == "decimal":
            return T.LongType() if self.precision <= 18 else T.DecimalType(38, 0)
        return T.DateType() if self.kind == "date" else T.StringType()

    @property
    def source(self) -> T.DataType:
        """Type under which a delimited file is read, before scaling."""
        return T.DecimalType(self.precision, self.scale) if self.kind == "decimal" else self.spark

    @property
    def domain(self) -> tuple[int, int] | None:
        """Inclusive bounds that the declaration alone guarantees."""
        if self.kind == "decimal":
            return -(10**self.precision), 10**self.precision
        if self.kind == "int":
            return -(2 ** (self.bits - 1)), 2 ** (self.bits - 1) - 1
        return None

    def adapt(self, col: Column, physical: T.DataType) -> Column:
        """``col`` of a stored table as this type's in-plan value."""
        if self.kind == "decimal":
            if isinstance(physical, T.DecimalType):
                scaled = col * F.lit(10**self.scale) if self.scale else col
                return scaled.cast(self.spark)
            if isinstance(physical, (T.DoubleType, T.FloatType)):
                # round before the cast: 0.07 * 100 is 7.000000000000001
                return _half_away(col * F.lit(10**self.scale)).cast(self.spark)
            return (col.cast("long") * F.lit(10**self.scale)).cast(self.spark)
        return col if physical == self.spark else col.cast(self.spark)

    def literal(self, text: str) -> int | str | dt.date:
        """A typed literal in the representation that plans compare with."""
        if self.kind == "decimal":
            return int((Decimal(text) * 10**self.scale).to_integral_value())
        if self.kind == "int":
            return int(text)
        return dt.date.fromisoformat(text) if self.kind == "date" else text


def _half_away(x: Column) -> Column:
    """Whole numbers, ties away from zero. Spark's ``round`` goes through
    decimal objects; this is two machine instructions but for ties."""
    near = F.rint(x)
    return F.when(F.abs(x - near) == 0.5, x + F.signum(x) * 0.5).otherwise(near)


def _bits_for(magnitude: int) -> int:
    return next(b for b in (8, 16, 32, 64, 128) if magnitude < 2 ** (b - 1))


def narrowest_bits(lo: int, hi: int) -> int:
    """Width of the narrowest signed integer that holds [lo, hi]."""
    return next(b for b in (8, 16, 32, 64, 128) if -(2 ** (b - 1)) <= lo and hi < 2 ** (b - 1))
