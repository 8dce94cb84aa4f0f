"""Packing into optimal length buckets.

A document in a bucket is padded to the bucket's length. From the histogram of
all lengths, dynamic programming finds the at most ``BUCKETS`` boundaries with
the least total padding. Inside each bucket documents form batches whose padded
size stays within a token budget.

The histogram reaches the driver with every distinct length below ``EXACT``
tokens, and on a grid finer than 1/130,000 of the length beyond. A corpus of k
distinct lengths has k * k / 2 tokens at least, so 100,000 bins need some 30 GB
of text; each bin's bound is its longest real length, so no document is ever
longer than its bucket. Documents are numbered within shards
of a bucket and the shards' counts are added up, so no bucket is sorted in one
place.

Defined cases: null and empty texts have 0 tokens and count as length 1 in a
batch; a document longer than the budget is a batch of its own; repeated rows
and shared ids are packed as often as they occur, spread over shards by a number
that is stored with each row; a null id sorts first; an empty table gives no
rows; :func:`pack` passes other columns through, but replaces those that have
the name of a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import durable

BUCKETS = 16
TOKEN_BUDGET = 65_536
EXACT = 1 << 18
SHARD_ROWS = 50_000
#: Rows up to which the shards' offsets are broadcast.
BROADCAST_SHARDS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def grid(n: Column) -> Column:
    """Lengths that are counted together: n itself below ``EXACT``."""
    bits = F.floor(F.log2(n.cast("double"))).cast("int")
    shift = F.greatest(bits - F.lit(EXACT.bit_length() - 2), F.lit(0))
    return F.when(n < EXACT, n).otherwise(F.call_function("shiftright", n, shift) * F.pow(F.lit(2.0), shift).cast("long"))


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds, each one of ``lengths`` (ascending), with least padding.

    best[k][j], the least padded size of the lengths up to j in k buckets, is
    min over i of best[k-1][i] + lengths[j] * (docs(j) - docs(i)): lines in
    lengths[j] with falling slopes, so one pass over a lower hull does a layer.
    """
    n = len(lengths)
    if not n:
        return []
    docs = [0]
    for c in counts:
        docs.append(docs[-1] + c)
    best = [0] + [lengths[j] * docs[j + 1] for j in range(n)]
    layers = []
    for _ in range(1, min(buckets, n)):
        hull: list[int] = []
        at, now, choice = 0, [0] * (n + 1), [0] * (n + 1)

        def worse(a: int, b: int, c: int, f=best) -> bool:
            # line b is never the least between lines a and c
            return (f[c] - f[a]) * (docs[b] - docs[a]) <= (f[b] - f[a]) * (docs[c] - docs[a])

        for j in range(1, n + 1):
            i = j - 1
            while len(hull) >= 2 and worse(hull[-2], hull[-1], i):
                hull.pop()
            hull.append(i)
            at, x = min(at, len(hull) - 1), lengths[j - 1]
            while at + 1 < len(hull) and best[hull[at + 1]] - x * docs[hull[at + 1]] <= best[hull[at]] - x * docs[hull[at]]:
                at += 1
            choice[j] = hull[at]
            now[j] = best[hull[at]] + x * (docs[j] - docs[hull[at]])
        layers.append(choice)
        best = now
    bounds, j = [], n
    for choice in reversed(layers):
        bounds.append(lengths[j - 1])
        j = choice[j]
        if not j:
            break
    if j:
        bounds.append(lengths[j - 1])
    return bounds[::-1]


def pack(lengths: DataFrame, length_col: str, order_by: list[str], buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``lengths`` with ``bucket``, ``bucket_length``, ``batch`` (within the
    bucket) and ``slot`` (within the batch). ``order_by`` tells rows apart."""
    lengths = lengths.drop("bucket", "bucket_length", "batch", "slot")
    n = F.col(f"`{length_col}`")
    bins = lengths.groupBy(grid(n).alias("g")).agg(F.max(n).alias("longest"), F.count(F.lit(1)).alias("docs")).collect()
    bins.sort(key=lambda r: r["longest"])
    bounds = optimal_bounds([r["longest"] for r in bins], [r["docs"] for r in bins], buckets) or [0]
    total = sum(r["docs"] for r in bins)
    shards = max(1, math.ceil(total / SHARD_ROWS))
    limits = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(limits, lambda b: b < n)).cast("int")
    rows = lengths.withColumn("bucket", bucket).withColumn("bucket_length", F.get(limits, bucket))
    rows = rows.withColumn("__shard", F.pmod(F.xxhash64(*order_by), F.lit(shards)).cast("int"))
    held = rows.groupBy("bucket", "__shard").agg(F.count(F.lit(1)).alias("__held"))
    before = Window.partitionBy("bucket").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("bucket").alias("__b"), F.col("__shard").alias("__s"), F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__before"))
    if shards * len(bounds) <= BROADCAST_SHARDS:
        held = F.broadcast(held)
    inside = Window.partitionBy("bucket", "__shard").orderBy(*order_by, length_col)
    rows = rows.withColumn("__row", F.row_number().over(inside)).join(held, (F.col("bucket") == F.col("__b")) & (F.col("__shard") == F.col("__s")))
    index = F.col("__before") + F.col("__row") - 1
    size = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))), F.lit(1)).cast("long")
    return rows.withColumn("batch", F.floor(index / size).cast("long")).withColumn("slot", F.pmod(index, size)).drop("__shard", "__b", "__s", "__before", "__row")


def packed_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` (words) with their place. Texts are read once."""
    return packed(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")), "n_tokens", ["doc_id"])


def packed(rows: DataFrame, length_col: str, order_by: list[str], buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """:func:`pack` of rows that need not differ: each is stored with a number of its own."""
    stored = durable(rows.withColumn("__number", F.monotonically_increasing_id()))
    return pack(stored, length_col, [*order_by, "__number"], buckets, budget).drop("__number")


def batches(packed: DataFrame, ids_col: str, pad: int = 0) -> DataFrame:
    """A row per batch: ``bucket, batch`` and ``rows``, the token ids of its
    documents by slot, each padded to the bucket's length. A batch holds no more
    than the token budget it was packed with, or one document."""
    ids = F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))
    fill = F.array_repeat(F.lit(pad), F.greatest(F.col("bucket_length") - F.size(ids), F.lit(0)).cast("int"))
    one = F.struct("slot", F.concat(ids, fill).alias("ids"))
    held = packed.groupBy("bucket", "batch").agg(F.sort_array(F.collect_list(one)).alias("s"))
    return held.select("bucket", "batch", F.transform("s", lambda x: x["ids"]).alias("rows"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
