"""Inner equi joins. Spark picks the strategy from sizes; nothing is forced but
where the matches outgrow the input, which Spark's sizes do not show.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches of a cell of a key and of a task, as means; a cell has SIDE rows of each side, or fewer of one and more of the other.
SIDE, TASK_MATCHES = 2048, 2**24
#: Input rows of a task, as a mean; most tasks of a join; hot keys that are broadcast.
TASK_ROWS, MOST_TASKS, BROADCAST_KEYS = 2**20, 50_000, 100_000
#: Up to so many matches for each input row a join without hot keys is left to Spark.
LINEAR = 8


def _condition(probe: DataFrame, build: DataFrame, keys: Sequence[tuple[str, str]]):
    cond = None
    for b, p in keys:
        one = F.col(f"p.`{p}`") == F.col(f"b.`{b}`")
        cond = one if cond is None else cond & one
    return cond


def _output(probe: DataFrame, keys: Sequence[tuple[str, str]], payloads: Sequence[str]):
    build = list(dict.fromkeys([*[b for b, _ in keys], *payloads]))
    return [F.col(f"p.`{c}`").alias(c) for c in probe.columns] + [F.col(f"b.`{c}`").alias(c) for c in build]


def inner(probe: DataFrame, build: DataFrame, keys: Sequence[tuple[str, str]], payloads: Sequence[str]) -> DataFrame:
    """All matches; probe columns, then build keys, then build payloads.

    ``keys`` are (build, probe) pairs; NULL never equals anything.
    """
    build = build.select(*dict.fromkeys([*[b for b, _ in keys], *payloads]))
    return probe.alias("p").join(build.alias("b"), _condition(probe, build, keys), "inner").select(*_output(probe, keys, payloads))


def many_to_many(probe: DataFrame, build: DataFrame, keys: Sequence[tuple[str, str]], payloads: Sequence[str]) -> DataFrame:
    """As :func:`inner`, for keys that neither side has once: matches may grow
    with the product of both sides, whatever few tasks the input is good for.

    One job counts the rows of each key. Where matches are many, a key's rows are
    dealt into a grid of cells: a row goes to one line of cells of its own side
    and is repeated along it, so that each pair meets in one cell. There are as
    many tasks as the matches and the dealt rows need, and a task's work does not
    grow with them. Dealt rows are the input, or some ``2 / SIDE`` of the matches.
    """
    build = build.select(*dict.fromkeys([*[b for b, _ in keys], *payloads]))
    names = [f"__k{i}" for i in range(len(keys))]
    common = build.select(*[F.col(f"`{b}`") for b, _ in keys]).union(probe.select(*[F.col(f"`{p}`") for _, p in keys])).schema

    def keyed(df: DataFrame, at: int) -> DataFrame:
        return df.withColumns({n: F.col(f"`{k[at]}`").cast(f.dataType) for n, k, f in zip(names, keys, common, strict=True)}).dropna(subset=names)

    sides = {"b": keyed(build, 0), "p": keyed(probe, 1)}
    b, p = (df.groupBy(*names).agg(F.count("*").cast("double").alias(n)) for n, df in sides.items())
    pairs, most = F.col("b") * F.col("p"), float(SIDE**2)
    lines = {f"__{own}s": F.greatest(F.lit(1), F.ceil(F.col(own) * F.least(F.col(other), F.lit(float(SIDE))) / most)) for own, other in ("bp", "pb")}
    counts = b.join(p, names, "full").fillna(0.0, ["b", "p"]).withColumns(lines)
    total, of_b, of_p, hot = counts.agg(F.sum(pairs), F.sum(F.col("b") * F.col("__ps")), F.sum(F.col("p") * F.col("__bs")), F.count_if(pairs > most)).first()
    if not total or total <= TASK_MATCHES or (not hot and total <= LINEAR * (of_b + of_p)):
        return inner(probe, build, keys, payloads)
    tasks = min(MOST_TASKS, 1 + int(total / TASK_MATCHES + (of_b + of_p) / TASK_ROWS))
    cells = counts.filter(pairs > most).select(*names, *lines)
    cells = F.broadcast(cells) if hot <= BROADCAST_KEYS else cells

    def dealt(own: str, other: str, rows: float) -> DataFrame:
        # sorted, so that a task that is run again deals its rows alike
        cols = [F.col(f"`{c}`") for c in sides[own].columns]
        x = sides[own].repartition(min(MOST_TASKS, 1 + int(rows / TASK_ROWS))).sortWithinPartitions(*cols)
        x = x.withColumn("__n", F.monotonically_increasing_id()).join(cells, names, "left")
        line = F.pmod(F.xxhash64("__n"), F.coalesce(f"__{own}s", F.lit(1)))
        along = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"__{other}s", F.lit(1)) - 1))
        x = x.withColumn(f"__{own}", line).withColumn(f"__{other}", along)
        # a key seen to be constant would be left out of the join, which would then deal all rows anew
        cell = {n: F.when(F.col("__n") >= 0, F.col(n)) for n in names}
        return x.withColumns(cell).select(*cols, "__b", "__p").repartition(tasks, *names, "__b", "__p")

    x, y = dealt("p", "b", of_p), dealt("b", "p", of_b)
    met = _condition(x, y, [(n, n) for n in (*names, "__b", "__p")])
    return x.alias("p").join(y.alias("b").hint("merge"), met, "inner").select(*_output(probe, keys, payloads))


def at_most_one(probe: DataFrame, build: DataFrame, keys: Sequence[tuple[str, str]], payloads: Sequence[str]) -> DataFrame:
    """Each probe row once if any build row matches.

    Without payloads this is a left semi join, and the build keys are copies of
    the probe keys. With payloads, the build side is first reduced to the
    smallest payload tuple of each key, so that the result is deterministic. A
    build side whose key is known to be unique needs :func:`inner` only.
    """
    names = list(dict.fromkeys(b for b, _ in keys))
    carried = [c for c in dict.fromkeys(payloads) if c not in names]
    if not carried:
        out = probe.alias("p").join(build.select(*names).alias("b"), _condition(probe, build, keys), "left_semi")
        copies = {b: p for b, p in reversed(keys)}
        return out.select(*[F.col(f"`{c}`") for c in probe.columns], *[F.col(f"`{copies[b]}`").alias(b) for b in names])
    if len(carried) == 1:  # a single number stays in a hash aggregate
        return inner(probe, build.groupBy(*names).agg(F.min(carried[0]).alias(carried[0])), keys, carried)
    one = build.groupBy(*names).agg(F.min(F.struct(*carried)).alias("__v")).select(*names, *[F.col(f"__v.`{c}`").alias(c) for c in carried])
    return inner(probe, one, keys, carried)
