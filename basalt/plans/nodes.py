"""Plan and expression nodes: plain immutable objects without behaviour."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass


class Expr:
    pass


@dataclass(frozen=True)
class ColumnId(Expr):
    name: str


@dataclass(frozen=True)
class Constant(Expr):
    value: int | str | dt.date


@dataclass(frozen=True)
class Assign(Expr):
    name: str
    value: Expr


@dataclass(frozen=True)
class Function(Expr):
    name: str
    args: tuple[Expr, ...]


class RelOp:
    pass


@dataclass(frozen=True)
class Scan(RelOp):
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Select(RelOp):
    child: RelOp
    predicate: Expr


@dataclass(frozen=True)
class Project(RelOp):
    child: RelOp
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class HashJoin(RelOp):
    build: RelOp
    build_keys: tuple[str, ...]
    build_payloads: tuple[str, ...]
    probe: RelOp
    probe_keys: tuple[str, ...]
    fk1: bool


@dataclass(frozen=True)
class HashGroupBy(RelOp):
    child: RelOp
    keys: tuple[str, ...]
    payloads: tuple[str, ...]
    aggregates: tuple[Assign, ...]


def column(name: str) -> ColumnId:
    return ColumnId(name.lower())


def constant(value: int | str | dt.date) -> Constant:
    """A literal; text made of digits and a sign is an integer."""
    if isinstance(value, str) and re.fullmatch(r"-?\d+", value):
        value = int(value)
    return Constant(value)


def assign(name: str, value: Expr) -> Assign:
    return Assign(name.lower(), value)


def function(name: str, *args: Expr | str | int) -> Function:
    return Function(name, tuple(a if isinstance(a, Expr) else column(a) if isinstance(a, str) else constant(a) for a in args))


def _names(items: Sequence[str | ColumnId]) -> tuple[str, ...]:
    return tuple((i.name if isinstance(i, ColumnId) else i).lower() for i in items)


class Builder:
    """Makes plan nodes, checking what can be checked without a catalog."""

    def scan(self, table: str, columns: Sequence[str]) -> Scan:
        return Scan(table.lower(), _names(columns))

    def select(self, child: RelOp, predicate: Expr) -> Select:
        return Select(child, predicate)

    def project(self, child: RelOp, items: Sequence[Expr]) -> Project:
        for i in items:
            if not isinstance(i, (ColumnId, Assign)):
                raise ValueError(f"a projected expression needs a name: {i}")
        return Project(child, tuple(items))

    def hash_join(self, build: RelOp, build_keys: Sequence, build_payloads: Sequence, probe: RelOp, probe_keys: Sequence, fk1: bool = False) -> HashJoin:
        if len(build_keys) != len(probe_keys) or not build_keys:
            raise ValueError("a join needs as many build keys as probe keys, and one at least")
        return HashJoin(build, _names(build_keys), _names(build_payloads), probe, _names(probe_keys), fk1)

    def hash_group_by(self, child: RelOp, keys: Sequence = (), payloads: Sequence = (), aggregates: Sequence[Assign] = ()) -> HashGroupBy:
        for a in aggregates:
            if not (isinstance(a, Assign) and isinstance(a.value, Function) and len(a.value.args) == 1 and isinstance(a.value.args[0], ColumnId)):
                raise ValueError(f"an aggregate is a named function of one column: {a}")
        if not keys and not aggregates:
            raise ValueError("a group-by needs keys or aggregates")
        if payloads and not keys:
            raise ValueError("payload columns need keys")
        return HashGroupBy(child, _names(keys), _names(payloads), tuple(aggregates))


def scanned_tables(plan: RelOp) -> set[str]:
    """Names of the tables that a plan reads."""
    if isinstance(plan, Scan):
        return {plan.table}
    if isinstance(plan, HashJoin):
        return scanned_tables(plan.build) | scanned_tables(plan.probe)
    return scanned_tables(plan.child)
