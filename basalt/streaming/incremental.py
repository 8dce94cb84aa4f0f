"""Runs a plan on each micro-batch of a streaming table.

Plans are finite; over a stream each arriving batch is registered as the
plan's table and the plan's rows for that batch go to the sink, once per batch
(the batch id is passed on so that a sink can skip one it has already stored).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..catalog import Catalog
from ..plans.lower import lower
from ..plans.nodes import RelOp


def run_on_batches(stream: DataFrame, table: str, declared: Mapping[str, str], plan: RelOp, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    def each(batch: DataFrame, batch_id: int) -> None:
        catalog = Catalog(batch.sparkSession)
        catalog.add(table, batch, declared)
        sink(lower(plan, catalog).df, batch_id)

    return stream.writeStream.foreachBatch(each)
