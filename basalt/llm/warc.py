"""WARC archives written by Spark's own writer and read by boundary chains.

Each page becomes a record; pages with equal payloads of at least
``LEAST_REVISIT`` bytes refer to the one with the smallest id (``revisit``).
Files hold at most ``FILE_BYTES`` of payload, or one record: records of a size
class share files, as many as its largest size allows.

Reading does not trust record marks. A task takes a file, scans it block by
block and emits, for every mark, the offset its record would end at. Those
(offset, successor) edges are a forest; pointer jumping from the start of the
file doubles the distance covered in every round and keeps only offsets that are
reached, so a mark inside a payload is never a record. Payloads are then read at
the reached offsets, where they lie: neither archives nor edges are exchanged.
A header ends before the next mark, so that marks are read in linear time.

Defined cases: a null payload is empty; a null id sorts first; rows with one
id and one payload are all responses; an empty table gives no rows; line breaks
in a URL become spaces; columns other than id, payload and ``url`` are not read,
so none can clash; a payload has 2 GB at most, as all values in Spark, with its
header. A file that does not start with a mark has no records; a record cut
short at the end of its file ends the chain and is dropped; a revisit of a
record that is nowhere has the digest that it states and null bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import durable, new_folder

LEAST_REVISIT = 100
#: Bytes of a block; marks that straddle two blocks belong to the first.
BLOCK = 4 << 20
FILE_BYTES = 64 << 20
#: Largest payload of a size class, in bytes; beyond the last a file has one record.
CLASSES = (8 << 10, 128 << 10, 2 << 20)
#: Revisits up to which their table is broadcast (16 bytes each).
BROADCAST_REVISITS = 200_000
_END = "\r\n\r\n"
#: A mark follows the end of a record or header, or starts the file.
_MARK = re.compile(rb"(?:\A|(?<=\r\n\r\n))WARC/1\.[01]\r\n")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_NULL_ID = -(2**63)
_DATE = "1970-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``__id, __payload, __digest, __refers`` and ``__url`` of each page."""
    rows = pages.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("__id"),
        F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("__payload"),
        (F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ") if "url" in pages.columns else F.lit("")).alias("__url"),
    ).withColumn("__digest", F.sha2("__payload", 256))
    same = rows.where(F.octet_length("__payload") >= LEAST_REVISIT).select("__id", "__digest")
    first = same.groupBy("__digest").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last")
    revisits = durable(same.join(first, "__digest").where("__id > __first").select(F.col("__id").alias("__rid"), F.col("__digest").alias("__rdigest"), F.col("__first").alias("__refers")).distinct())
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    return rows.join(revisits, (F.col("__id") == F.col("__rid")) & (F.col("__digest") == F.col("__rdigest")), "left").drop("__rid", "__rdigest")


def write_warc(rows: DataFrame, folder: str, sizes: Column | None = None, of: DataFrame | None = None) -> None:
    """The rows of :func:`with_revisits` as archives, one per task or more. The
    classes that there are come from ``sizes`` of the table ``of`` that the rows
    were made from, which is cheaper, or from the rows."""
    again = F.col("__refers").isNotNull()
    body = F.when(again, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("__payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("__id")),
        F.lit(f"\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: "), F.col("__url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("__digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("__refers")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END),
    )
    size = F.octet_length("__payload")
    edges = [0, *CLASSES]
    found = rows.select(size.alias("s")) if of is None else of.select(sizes.alias("s"))
    held = found.select(*[F.count_if(F.col("s") > e).alias(f"n{i}") for i, e in enumerate(edges)], F.count(F.lit(1)).alias("n")).first()
    over = [held["n"], *[held[f"n{i}"] for i in range(1, len(edges))], 0]
    record = rows.select(F.concat(head, body).alias("value"), size.alias("size"))
    for i, (low, more) in enumerate(zip(edges, over[1:], strict=True)):
        if over[i] == more and i:  # no record of this class
            continue
        of_class = record if not i else record.where(F.col("size") > low)
        if i < len(CLASSES):
            of_class = of_class.where(F.col("size") <= CLASSES[i])
        most = max(1, FILE_BYTES // CLASSES[i]) if i < len(CLASSES) else 1
        of_class.select("value").write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", most).option("compression", "gzip").text(folder)


def archive(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def header(data: bytes, at: int, stop: int | None = None) -> tuple[dict[str, str], int] | None:
    """Fields of the record that a mark at this offset would start, and where its
    block starts; none if the header does not end before ``stop``."""
    end = data.find(b"\r\n\r\n", at, stop)
    if end < 0:
        return None
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if sep:
            fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return fields, end + 4


def successor(data: bytes, at: int, stop: int | None = None) -> int:
    """Offset behind the record at this mark, or -1 if it is none."""
    found = header(data, at, stop)
    if found is None or not re.fullmatch(r"\d{1,18}", found[0].get("content-length", "")):
        return -1
    end = found[1] + int(found[0]["content-length"]) + 4
    return end if end <= len(data) and data[end - 4 : end] == b"\r\n\r\n" else -1


def marks(data: bytes, block: int = BLOCK) -> Iterator[int]:
    for start in range(0, max(len(data), 1), block):
        for m in _MARK.finditer(data, start, min(len(data), start + block + 9)):
            if m.start() < start + block and (m.start() == 0 or data[m.start() - 4 : m.start()] == b"\r\n\r\n"):
                yield m.start()


def candidates(data: bytes, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(offset, successor) of every mark. A header reaches to the next mark at
    most, which begins behind its last line."""
    before = None
    for at in marks(data, block):
        if before is not None:
            yield before, successor(data, before, at)
        before = at
    if before is not None:
        yield before, successor(data, before)


def reached(offsets: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Records on the chain from offset 0, by pointer jumping.

    The last record's successor is the end of the file, which is no mark.
    """
    order = np.argsort(offsets)
    offsets, after = offsets[order], after[order]
    n = len(offsets)
    if not n or offsets[0] != 0:
        return np.zeros(0, np.int64)
    to = np.minimum(np.searchsorted(offsets, after), n - 1)
    jump = np.append(np.where((offsets[to] == after) & (after > offsets), to, n), n)
    on = np.zeros(n + 1, bool)
    on[0] = True
    for _ in range(max(1, n.bit_length())):
        on[jump[np.flatnonzero(on)]] = True
        jump = jump[jump]
    on = on[:n] & (after >= 0)
    return offsets[on]


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Records: ``path, offset, record_type, page_id, refers_to, declared_digest,
    payload_bytes, payload_digest`` (both of the bytes stored in the record)
    and, if asked for, ``payload``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")

    out = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    if payloads:
        out = out.append(pa.field("payload", pa.binary()))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = archive(content.as_buffer().to_pybytes())
                edges = np.array(list(candidates(data)), np.int64).reshape(-1, 2)
                rows, held = [], 0
                for at in reached(edges[:, 0], edges[:, 1]).tolist():
                    rows.append(_record(data, path, at, payloads))
                    held += rows[-1]["payload_bytes"] if payloads else 1 << 10
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=out)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    schema = "path string, offset long, record_type string, page_id long, refers_to long, declared_digest string, payload_bytes long, payload_digest string" + (", payload binary" if payloads else "")
    return files.mapInArrow(take, schema)


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def _record(data: bytes, path: str, at: int, payloads: bool) -> dict:
    fields, start = header(data, at)
    end = start + int(fields["content-length"])
    http = data.find(b"\r\n\r\n", start, end)
    payload = data[http + 4 if http >= 0 else start : end]
    row = {
        "path": path, "offset": at, "record_type": fields.get("warc-type"), "page_id": _page(fields.get("warc-record-id")),
        "refers_to": _page(fields.get("warc-refers-to")), "declared_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"),
        "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(),
    }
    return row | ({"payload": payload} if payloads else {})


def resolved(records: DataFrame) -> DataFrame:
    """Records with the full payload's size and digest: a revisit's are those
    of the response it refers to."""
    records = durable(records)
    whole = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    source = whole.groupBy(F.col("page_id").alias("__source"), F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("__bytes"))
    again = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "declared_digest")
    again = again.join(source, (F.col("refers_to") == F.col("__source")) & (F.col("declared_digest") == F.col("__digest")), "left")
    return whole.unionByName(again.select("page_id", F.col("__bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to"))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "warc")
    write_warc(with_revisits(pages, "page_id", "html"), folder, F.octet_length("html"), pages)
    shown = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(c)
    return resolved(read_warc(spark, folder)).select(shown("page_id"), "payload_bytes", "payload_digest", "record_type", shown("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
     f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""
