"""Named functions available in plans, as builders of Column expressions.

Everything here stays inside whole-stage code generation: no Python runs per
row. Each scalar also says what value range its result has, so that sums can
be given a type that cannot overflow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Domain = tuple[int, int] | None
LONG = (-(2**63), 2**63 - 1)
BOOL: Domain = (0, 1)


@dataclass(frozen=True)
class Scalar:
    name: str
    arity: int
    build: Callable[..., Column]
    domain: Callable[..., Domain]
    boolean: bool = False


SCALARS: dict[str, Scalar] = {}


def register_scalar(name: str, arity: int, build: Callable[..., Column], domain=lambda *d: None, boolean: bool = False) -> None:
    """Adds a function; the extension point for user-defined expressions."""
    SCALARS[name] = Scalar(name, arity, build, (lambda *d: BOOL) if boolean else domain, boolean)


def _exact(domain: Domain) -> T.DataType:
    """Integer type in which arithmetic with this result range is exact."""
    return T.LongType() if domain and LONG[0] <= domain[0] and domain[1] <= LONG[1] else T.DecimalType(38, 0)


def _arith(op: Callable[[Column, Column], Column]):
    def build(a: Column, b: Column, out: Domain) -> Column:
        to = _exact(out)
        return op(a.cast(to), b.cast(to)).cast(to)

    return build


def _corners(op: Callable[[int, int], int]):
    def domain(a: Domain, b: Domain) -> Domain:
        if a is None or b is None:
            return None
        ends = [op(x, y) for x in a for y in b]
        return min(ends), max(ends)

    return domain


for _name, _op in {"=": "__eq__", "<": "__lt__", ">": "__gt__", "!=": "__ne__", "<=": "__le__", ">=": "__ge__"}.items():
    register_scalar(_name, 2, lambda a, b, o=_op: getattr(a, o)(b), boolean=True)
for _name in ("&&", "&"):
    register_scalar(_name, 2, lambda a, b: a & b, boolean=True)
for _name in ("||", "|"):
    register_scalar(_name, 2, lambda a, b: a | b, boolean=True)
register_scalar("!", 1, lambda a: ~a, boolean=True)
register_scalar("contains", 2, lambda a, b: F.contains(a, b), boolean=True)
register_scalar("between", 3, lambda x, lo, hi: (x >= lo) & (x <= hi), boolean=True)
register_scalar("between<", 3, lambda x, lo, hi: (x >= lo) & (x < hi), boolean=True)
register_scalar("between>", 3, lambda x, lo, hi: (x > lo) & (x <= hi), boolean=True)
register_scalar("between<>", 3, lambda x, lo, hi: (x > lo) & (x < hi), boolean=True)
register_scalar("extract_year", 1, F.year, lambda d: (0, 3000))
register_scalar(
    "ifthenelse", 3, lambda c, a, b: F.when(c, a).otherwise(b),
    lambda c, a, b: None if a is None or b is None else (min(a[0], b[0]), max(a[1], b[1])),
)
ARITHMETIC = {"+": _arith(lambda a, b: a + b), "-": _arith(lambda a, b: a - b), "*": _arith(lambda a, b: a * b)}
register_scalar("+", 2, ARITHMETIC["+"], _corners(lambda x, y: x + y))
register_scalar("-", 2, ARITHMETIC["-"], _corners(lambda x, y: x - y))
register_scalar("*", 2, ARITHMETIC["*"], _corners(lambda x, y: x * y))


@dataclass(frozen=True)
class Aggregate:
    """``build`` takes the column, its range, the result's range and the row bound."""

    name: str
    build: Callable[[Column, Domain, Domain, int], Column]
    domain: Callable[[Domain, int], Domain]


def _sum(c: Column, arg: Domain, out: Domain, rows: int) -> Column:
    """An exact sum. One that may leave 64 bits is added up in digits that
    cannot, so that no row makes a decimal object."""
    if _exact(out) == T.LongType():
        return F.sum(c.cast("long")).cast("long")
    wide = T.DecimalType(38, 0)
    if _exact(arg) != T.LongType():
        return F.sum(c.cast(wide)).cast(wide)
    bits = 62 - rows.bit_length()
    if bits < 8:
        return F.sum(c.cast(wide)).cast(wide)
    x, largest = c.cast("long"), max(abs(arg[0]), abs(arg[1]))
    total, low = None, 0
    while low == 0 or largest >> low:
        last = not largest >> (low + bits)
        # floor division by a power of two: the last digit has the sign
        digit = F.shiftright(x, low) if low else x
        digit = digit if last else digit.bitwiseAND(F.lit((1 << bits) - 1))
        part = F.sum(digit).cast(wide) * F.lit(str(1 << low)).cast(wide) if low else F.sum(digit).cast(wide)
        total = part if total is None else (total + part).cast(wide)
        low += bits
    return total.cast(wide)


AGGREGATES: dict[str, Aggregate] = {
    "sum": Aggregate("sum", _sum, lambda d, n: None if d is None else (min(0, d[0]) * n, max(0, d[1]) * n)),
    "count": Aggregate("count", lambda c, *_: F.count(F.lit(1)), lambda d, n: (0, n)),
    "min": Aggregate("min", lambda c, *_: F.min(c), lambda d, n: d),
    "max": Aggregate("max", lambda c, *_: F.max(c), lambda d, n: d),
}
