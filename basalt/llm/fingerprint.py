"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A document's sketch is the sorted set of the hashes of its five-word shingles
that lie below a fixed share ``FRACTION`` of the hash range. The threshold does
not depend on the document, so sketches merge by union, and the share of one
sketch found in another estimates containment however unequal the documents
are. A set of at most ``WHOLE`` shingles is kept whole and marked so: two such
sketches are compared exactly, and where only one is whole its hashes below the
threshold are what the other is compared with. Whether a sketch is whole
depends on the set alone, so the union of two sketches is the sketch of the
union, whole or not.

Defined cases: a null text is empty; an empty table gives no rows; a text of any
length is taken whole; other columns are not read, so none can clash; a text of
fewer than five words is one shingle; only a text without words has an empty
fingerprint (but for a chance of (3/4)^65); equal fingerprints have likeness 1,
an empty and another 0; so has a whole sketch without a hash below the
threshold against one that is not whole, which does not hold what could tell; a
null id sorts first; rows that share an id are one place in the order of
documents, and the one with the least text hash stands for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
FRACTION = 1 / 4
#: Shingles of a set that is kept whole, at most.
WHOLE = 64
#: Words are what lies between these characters.
_SPACE = r"[\x20\x09-\x0D]+"
#: Ranges of ids that are ordered apart; at most this many.
MAX_RANGES = 4096
RANGE_ROWS = 1_000
_NULL_ID = -(2**63)


def with_sketch(df: DataFrame, text_col: str, out: str, fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with ``out``, the text's sketch: if it is ``whole``, and its sorted ``hashes``."""
    w, h = f"{out}__w", f"{out}__h"
    df = df.withColumn(w, F.transform(F.filter(F.split(F.col(text_col), _SPACE), lambda x: x != ""), lambda x: F.xxhash64(x)))
    n = F.size(w)
    at = lambda i, k: F.get(F.col(w), i + k)
    rolling = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[at(i, k) for k in range(shingle)]))
    some = F.when(n >= shingle, rolling).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(h, F.array_distinct(some))
    return df.withColumn(out, _sketch(F.col(h), F.lit(True), fraction)).drop(w, h)


def _sketch(distinct: Column, all_: Column, fraction: float) -> Column:
    """The sketch of distinct hashes, which are ``all_`` of their set or hold those below the threshold."""
    whole = all_ & (F.size(distinct) <= WHOLE)
    return F.struct(whole.alias("whole"), F.sort_array(F.when(whole, distinct).otherwise(_low(distinct, fraction))).alias("hashes"))


def _low(hashes: Column, fraction: float) -> Column:
    limit = F.lit(-(2**63) + int(2**64 * fraction))
    return F.filter(hashes, lambda x: x < limit)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of all shingles of two documents, from their sketches."""
    return _sketch(F.array_union(a["hashes"], b["hashes"]), a["whole"] & b["whole"], fraction)


def likeness(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Containment of the smaller document in the larger: exact between whole
    sketches, else estimated from the hashes below the threshold."""

    def share(x: Column, y: Column) -> Column:
        least = F.least(F.size(x), F.size(y))
        return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)

    p, q = a["hashes"], b["hashes"]
    return F.when(a == b, 1.0).when(a["whole"] & b["whole"], share(p, q)).otherwise(share(_low(p, fraction), _low(q, fraction)))


def shown(sketch: Column) -> Column:
    """The hashes in hexadecimal, behind ``=`` if they are a whole set's."""
    hashes = F.array_join(F.transform(sketch["hashes"], lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.concat(F.when(sketch["whole"] & (F.size(sketch["hashes"]) > 0), "=").otherwise(""), hashes)


def next_ids(ids: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids with the next larger one, and after the last the first.

    Ids are ordered within ranges between approximate quantiles; only the first
    id of each range, at most ``MAX_RANGES`` rows, is seen by the other ranges.
    """
    rows = ids.count()
    ranges = max(1, min(MAX_RANGES, math.ceil(rows / RANGE_ROWS)))
    cuts: list[int] = []
    if ranges > 1:
        found = ids.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first()[0]
        cuts = sorted(set(found or []))
    step = max(1, math.isqrt(len(cuts)))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if parts:
        c = F.col(id_col)
        # the count of cuts at or below the id, by a coarse and a fine search
        major = F.size(F.filter(F.array(*[F.lit(p[0]).cast("bigint") for p in parts]), lambda x: x <= c))
        fine = F.array(F.array().cast("array<bigint>"), *[F.array(*[F.lit(x).cast("bigint") for x in p]) for p in parts])
        ids = ids.withColumn("__major", major)
        minor = F.size(F.filter(F.get(fine, F.col("__major")), lambda x: x <= c))
        ids = ids.withColumn("__range", F.when(F.col("__major") == 0, 0).otherwise((F.col("__major") - 1) * step + minor)).drop("__major")
    else:
        ids = ids.withColumn("__range", F.lit(0))
    firsts = ids.groupBy("__range").agg(F.min(id_col).alias("__first"))
    order = Window.orderBy("__range")
    firsts = firsts.withColumn("__after", F.coalesce(F.lead("__first").over(order), F.min("__first").over(Window.partitionBy(F.lit(0)))))
    inside = Window.partitionBy("__range").orderBy(id_col)
    ids = ids.withColumn("__lead", F.lead(id_col).over(inside))
    return ids.join(F.broadcast(firsts), "__range").withColumn("next_id", F.coalesce("__lead", "__after")).drop("__range", "__lead", "__first", "__after")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("__id"), text.alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its text's sketch: ``__id, text, sketch``."""
    return with_sketch(_rows(docs, id_col, text_col), "text", "sketch")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, its text with the last half of its characters replaced by
    the start of the next document's, and the sketches of all three.

    Columns: ``__id, text, n_chars, sketch, edited, edited_sketch, next_sketch``.
    Texts are exchanged once by id, and half of each once more, with its sketch,
    to the document before it; nothing is sorted globally. A text's own sketch
    is made again behind the exchange, which is cheaper than to send it.
    """
    rows = _rows(docs, id_col, text_col)  # the same columns on both sides below, so that one exchange serves both
    raw = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("__id"), F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).alias("n"))
    ids = next_ids(raw.groupBy("__id").agg(F.floor(F.max("n") / 2).cast("int").alias("half")), "__id")
    before = ids.select(F.col("next_id").alias("__id"), F.col("__id").alias("before_id"), F.col("half").alias("before_half"))
    halves = (
        with_sketch(rows.join(before, "__id"), "text", "sketch")
        .select(F.col("before_id").alias("__id"), F.struct(F.xxhash64("text").alias("h"), F.substring(F.col("text"), F.lit(1), F.col("before_half")).alias("start"), F.col("sketch")).alias("v"))
        .groupBy("__id").agg(F.min("v").alias("v"))
    )
    both = rows.join(halves, "__id")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("v.start"), F.lit(1), half))
    both = both.select("__id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("v.sketch").alias("next_sketch"))
    return with_sketch(with_sketch(both, "text", "sketch"), "edited", "edited_sketch")


def op7_fingerprint(spark, sf_dir: str) -> DataFrame:
    x = compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return x.select(
        F.when(F.col("__id") != _NULL_ID, F.col("__id")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("sketch")).alias("fingerprint"), shown(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
