"""Result rendering, discarding, run profiles and scan progress."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import setting
from .plans.lower import Lowered
from .types import JULIAN_OFFSET


def rendered(df: DataFrame | Lowered, char1: Mapping[str, bool] | None = None) -> DataFrame:
    """One ``row`` column: values joined by ``|``, dates as Julian Day Numbers
    and ``char(1)`` columns as character codes. A lowered plan knows which those
    are; of a DataFrame they are named in ``char1``. Row order is free."""
    if isinstance(df, Lowered):
        df, char1 = df.df, dict.fromkeys(df.char1, True) | dict(char1 or {})
    coded = {c for c, on in (char1 or {}).items() if on}
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.unix_date(c.cast("date")) + F.lit(JULIAN_OFFSET)
        elif f.name in coded:
            c = F.ascii(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        parts.append(c.cast("string"))
    return df.select(F.concat_ws("|", *parts).alias("row"))


def discard(df: DataFrame) -> None:
    """Runs the query without keeping its rows."""
    df.write.format("noop").mode("overwrite").save()


def _nodes(plan) -> Iterator:
    """The operators of a physical plan as it was run: what adaptive execution
    made of it, and the stages inside it."""
    inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "TableCacheQueryStage": "plan", "ResultQueryStage": "plan"}
    name = plan.nodeName()
    if name in inner:
        yield from _nodes(getattr(plan, inner[name])())
        return
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _metrics(plan) -> dict[str, int]:
    out, it = {}, plan.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        out[pair._1()] = pair._2().value()
    return {k: v for k, v in out.items() if v > 0}


def profile(df: DataFrame) -> str:
    """Runs the query and drops its rows; JSON of its wall time, its rows and
    the operators of the final plan, each with Spark's metrics of it."""
    execution = df._jdf.queryExecution()
    began = time.perf_counter()
    rows = execution.toRdd().count()
    seconds = time.perf_counter() - began
    nodes = [{"operator": n.nodeName().strip(), "metrics": _metrics(n)} for n in _nodes(execution.executedPlan())]
    return json.dumps({"seconds": round(seconds, 6), "rows": rows, "columns": df.columns, "operators": nodes})


def run(query: DataFrame | Lowered) -> tuple[DataFrame | None, str | None]:
    """Rendered rows, or none without ``enable_output``, which then runs the
    query for its time only; and its profile, with ``enable_profiling``."""
    df = query.df if isinstance(query, Lowered) else query
    on = {k: setting(df.sparkSession, k) == "true" for k in ("enable_output", "enable_profiling")}
    told = profile(df) if on["enable_profiling"] else None
    if on["enable_output"]:
        return rendered(query), told
    if told is None:
        discard(df)
    return None, told


def progress(spark: SparkSession, group: str) -> float:
    """Share of the tasks done, of all stages that a job group has started: for
    a query that streams its scan this is the share of the scan that is read."""
    tracker = spark.sparkContext.statusTracker()
    done = total = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in map(tracker.getStageInfo, info.stageIds if info else ()):
            if stage is not None:
                done, total = done + stage.numCompletedTasks, total + stage.numTasks
    return done / total if total else 0.0
