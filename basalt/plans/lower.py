"""Plans to DataFrames. Catalyst does the optimising; this adds semantics.

* A projected name is visible to later items of its list; an input column of
  the same name wins.
* An at-most-one-match join yields each probe row once. With no payload it is
  a left semi join; where the build key is unique, an inner join; otherwise the
  build side is reduced to one row per key (the smallest payload tuple, so that
  the outcome is deterministic).
* Payload columns of a group-by that its keys determine are hashed with them;
  others are carried, not compared.
* A global aggregate over no rows yields no row.
* Sums take a 64-bit type where the declared value range allows it for
  ``max_tuples`` rows, and ``decimal(38,0)`` otherwise. Tables are never counted
  for it.
* A join whose keys are unique on neither side has its matches counted by key
  while it is lowered, and as many tasks as they need.

What is unique and what determines what follows from the catalog's declared
keys: scans, filters, joins and groupings pass it on.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..config import setting
from ..functions.registry import AGGREGATES, ARITHMETIC, SCALARS, Domain
from ..operators.aggregate import distinct_keys, global_aggregate, grouped
from ..operators.join import at_most_one, inner, many_to_many
from . import nodes as N
from .pushdown import implied


@dataclass(frozen=True)
class Value:
    """A lowered expression: its Column, its range, and if it is a truth value."""

    col: Column
    domain: Domain = None
    boolean: bool = False


@dataclass(frozen=True)
class Lowered:
    """A lowered plan: rows, the range of each column, which column sets are
    unique, which sets determine which others, and which columns are ``char(1)``."""

    df: DataFrame
    domains: dict[str, Domain]
    unique: tuple[frozenset[str], ...] = ()
    determines: tuple[tuple[frozenset[str], frozenset[str]], ...] = ()
    char1: frozenset[str] = frozenset()

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def is_unique(self, columns: Iterable[str]) -> bool:
        held = frozenset(columns)
        return any(u <= held for u in self.unique)

    def closure(self, columns: Iterable[str]) -> frozenset[str]:
        """All columns whose values these determine."""
        held = frozenset(columns)
        while True:
            more = held.union(*(b for a, b in self.determines if a <= held))
            if more == held:
                return held
            held = more


def lower(plan: N.RelOp, catalog: Catalog, reorder_filters: bool = False) -> Lowered:
    """The plan's rows. ``reorder_filters`` orders conjuncts by estimated selectivity."""
    if reorder_filters:
        from .tune import order_filters

        plan = order_filters(plan, catalog)
    return _lower(plan, catalog)


def _lower(node: N.RelOp, catalog: Catalog) -> Lowered:
    return _RULES[type(node)](node, catalog)


def evaluate(expr: N.Expr, env: dict[str, Value]) -> Value:
    if isinstance(expr, N.ColumnId):
        if expr.name not in env:
            raise KeyError(f"unknown column {expr.name!r}; there are {sorted(env)}")
        return env[expr.name]
    if isinstance(expr, N.Constant):
        return _constant(expr.value)
    if isinstance(expr, N.Assign):
        return evaluate(expr.value, env)
    if expr.name not in SCALARS:
        raise KeyError(f"unknown function {expr.name!r}")
    fn, args = SCALARS[expr.name], [evaluate(a, env) for a in expr.args]
    if len(args) != fn.arity:
        raise ValueError(f"{expr.name} takes {fn.arity} arguments, not {len(args)}")
    if expr.name in ("&&", "&", "||", "|", "!"):
        args = [a if a.boolean else replace(a, col=a.col != 0) for a in args]
    elif expr.name == "ifthenelse":
        args = [args[0] if args[0].boolean else replace(args[0], col=args[0].col != 0), *map(_as_int, args[1:])]
    else:
        args = [_as_int(a) for a in args]
    out = fn.domain(*[a.domain for a in args])
    cols = [a.col for a in args]
    return Value(fn.build(*cols, out) if expr.name in ARITHMETIC else fn.build(*cols), out, fn.boolean)


def _as_int(v: Value) -> Value:
    return Value(v.col.cast("int"), (0, 1)) if v.boolean else v


def _constant(v: int | str | dt.date) -> Value:
    if isinstance(v, bool):
        v = int(v)
    if isinstance(v, int):
        wide = not -(2**63) <= v < 2**63
        return Value(F.lit(str(v)).cast("decimal(38,0)") if wide else F.lit(v), (v, v))
    return Value(F.lit(v))


def _env(x: Lowered) -> dict[str, Value]:
    return {c: Value(F.col(f"`{c}`"), x.domains.get(c)) for c in x.columns}


def _scan(n: N.Scan, catalog: Catalog, filters: list[N.Expr] = ()) -> Lowered:
    t = catalog.table(n.table)
    if unknown := set(n.columns) - set(t.columns):
        raise KeyError(f"{n.table} has no column {sorted(unknown)}")
    implied_filters = [c for f in filters for c in implied(t, f)]
    held = frozenset(n.columns)
    unique = tuple(u for u in t.unique if u <= held)
    char1 = frozenset(c for c in held if t.columns[c].kind == "char1")
    return Lowered(t.scan(n.columns, implied_filters), {c: t.columns[c].domain for c in n.columns}, unique, tuple((u, held) for u in unique), char1)


def _select(n: N.Select, catalog: Catalog) -> Lowered:
    chain, child = [n.predicate], n.child
    while isinstance(child, N.Select):
        chain, child = [child.predicate, *chain], child.child
    x = _scan(child, catalog, chain) if isinstance(child, N.Scan) else _lower(child, catalog)
    for predicate in chain:
        v = evaluate(predicate, _env(x))
        x = replace(x, df=x.df.filter(v.col if v.boolean else v.col != 0))
    return x


def _project(n: N.Project, catalog: Catalog) -> Lowered:
    x = _lower(n.child, catalog)
    base, env = _env(x), _env(x)
    out: dict[str, Value] = {}
    for item in n.items:
        v = _as_int(evaluate(item, env))
        out[item.name] = v
        if isinstance(item, N.Assign) and item.name not in base:
            env[item.name] = v
    # where a column is only passed on, what is known of it goes with it
    names: dict[str, str] = {}
    for item in n.items:
        source = item.value if isinstance(item, N.Assign) else item
        if isinstance(source, N.ColumnId) and source.name in base:
            names.setdefault(source.name, item.name)
    df = x.df.select(*[v.col.alias(c) for c, v in out.items()])
    return Lowered(df, {c: v.domain for c, v in out.items()}, *_renamed(x, names), frozenset(names[c] for c in x.char1 if c in names))


def _renamed(x: Lowered, names: dict[str, str]):
    """What is unique and what determines what, for the columns that stay."""
    at = lambda cs: frozenset(names[c] for c in cs if c in names)
    whole = names.keys()
    return tuple(at(u) for u in x.unique if u <= whole), tuple((at(a), at(x.closure(a))) for a, _ in x.determines if a <= whole)


def _join(n: N.HashJoin, catalog: Catalog) -> Lowered:
    b, p = _lower(n.build, catalog), _lower(n.probe, catalog)
    # A name on both sides means the build column above the join; the probe
    # column stays in the output under another name.
    taken = set(n.build_keys) | set(n.build_payloads)
    hidden = {c: f"{c}__probe" for c in p.columns if c in taken}
    probe = p.df.withColumnsRenamed(hidden)
    keys = [(bk, hidden.get(pk, pk)) for bk, pk in zip(n.build_keys, n.probe_keys, strict=True)]
    payloads = list(dict.fromkeys(n.build_payloads))
    one = b.is_unique(n.build_keys)
    if n.fk1 and (not one or not set(payloads) - set(n.build_keys)):
        df = at_most_one(probe, b.df, keys, payloads)
    elif one or p.is_unique(n.probe_keys):
        df = inner(probe, b.df, keys, payloads)
    else:
        df = many_to_many(probe, b.df, keys, payloads)
    domains = {hidden.get(c, c): d for c, d in p.domains.items()}
    domains |= {c: b.domains.get(c) for c in taken}
    unique, determines = _renamed(p, {c: hidden.get(c, c) for c in p.columns})
    of_build = _renamed(b, {c: c for c in taken})[1]
    if n.fk1:  # one row of the build side for each key
        of_build += ((frozenset(n.build_keys), frozenset(taken)),)
    equal = tuple((frozenset([x]), frozenset([y])) for k in keys for x, y in (k, k[::-1]))
    char1 = frozenset(hidden.get(c, c) for c in p.char1) | (b.char1 & taken)
    return Lowered(df, domains, unique if n.fk1 or one else (), determines + of_build + equal, char1)


def _group(n: N.HashGroupBy, catalog: Catalog) -> Lowered:
    x = _lower(n.child, catalog)
    env = _env(x)
    bound = int(setting(x.df.sparkSession, "max_tuples"))
    aggs, domains = [], {c: x.domains.get(c) for c in (*n.keys, *n.payloads)}
    for a in n.aggregates:
        if a.value.name not in AGGREGATES:
            raise KeyError(f"unknown aggregate {a.value.name!r}")
        fn, arg = AGGREGATES[a.value.name], evaluate(a.value.args[0], env)
        domains[a.name] = fn.domain(arg.domain, bound)
        aggs.append(fn.build(arg.col, arg.domain, domains[a.name], bound).alias(a.name))
    if not n.keys:
        df = global_aggregate(x.df, aggs, [a.name for a in n.aggregates])
    elif not aggs and not n.payloads:
        df = distinct_keys(x.df, n.keys)
    else:
        known = x.closure(n.keys)
        df = grouped(x.df, n.keys, n.payloads, aggs, known)
    held = frozenset(df.columns)
    keys = frozenset(n.keys)
    kept = {c: c for c in (*n.keys, *n.payloads)}
    char1 = (x.char1 & kept.keys()) | {a.name for a in n.aggregates if a.value.name in ("min", "max") and a.value.args[0].name in x.char1}
    return Lowered(df, domains, (keys,) if keys else (), _renamed(x, kept)[1] + ((keys, held),) if keys else (), frozenset(char1))


_RULES = {N.Scan: _scan, N.Select: _select, N.Project: _project, N.HashJoin: _join, N.HashGroupBy: _group}
