"""Documents in groups, and exchanges of packed hash sets between them.

Operators that compare all documents with each other share one shape:

1. documents are dealt into groups of a bounded number of bytes by a hash of
   their id and text (one exchange of the texts, reused by every later step);
2. each group sends the *set* of its hashes, once each however often they
   occur there, packed and sorted, to the parts of the hash space;
3. a part answers each group with bits per hash ("also elsewhere");
4. groups recompute their hashes and act on the answer.

A hash that a third of all rows hold is sent once per group, so no part grows
with a hot key, and no answer is larger than what was asked. A group sends
``RADIX`` packages. Where the hash space needs more parts than that, packages of
``RADIX`` groups for one part are merged first and sent on by the next digit of
the hash (``exchanged``): packages grow in proportion to the text, and each task
holds about as many hashes as a group has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text in a group; a group is held in one Python worker's memory.
GROUP_BYTES = 12 << 20
#: Below this, more groups only add overhead.
LEAST_GROUP_BYTES = 2 << 20
#: Parts of the hash space that a group, or merged groups, send to.
RADIX = 64
#: Internal columns: group, id (null: the least long), hash of the text, text as bytes.
G, ID, HASH, TEXT = "__g", "__id", "__h", "__text"
NULL_ID = -(2**63)
ASK = "__p long, __g int, __n long, __blob binary"
ANSWER = "__g int, __p long, __kind int, __blob binary"


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts; one scan of that column."""
    return int(docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long"))).first()[0] or 0)


def group_count(docs: DataFrame, total: int) -> int:
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(total / GROUP_BYTES), min(wanted, math.ceil(total / LEAST_GROUP_BYTES)))


def grouped(docs: DataFrame, id_col: str, text_col: str, groups: int, keep: Sequence[str] = ()) -> DataFrame:
    """``__g, __id, __h, __text`` and the ``keep`` columns as ``__k0 ...`` in that
    order, so names of ``docs`` never clash. Rows of one id are spread."""
    one_id = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"").cast("binary"))
    kept = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    return docs.select(F.pmod(F.xxhash64(one_id, text), F.lit(groups)).cast("int").alias(G), one_id.alias(ID), F.xxhash64(text).alias(HASH), text.alias(TEXT), *kept)


def shown_id(col: str = ID):
    """The id as given: null where it was null."""
    return F.when(F.col(col) != NULL_ID, F.col(col))


def ordered(table: pa.Table) -> pa.Table:
    """A group's rows in an order that does not depend on how they arrived."""
    return table.take(pc.sort_indices(table, sort_keys=[(ID, "ascending"), (HASH, "ascending"), (TEXT, "ascending")])).combine_chunks()


class Texts:
    """The texts of an ordered group as one byte array with offsets."""

    def __init__(self, table: pa.Table):
        self.ids = table.column(ID).to_numpy()
        column = table.column(TEXT)
        parts = [c.cast(pa.large_binary()) for c in column.chunks]
        array = pa.concat_arrays(parts) if len(parts) > 1 else parts[0] if parts else pa.array([], pa.large_binary())
        offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
        data = array.buffers()[2] if len(array) else None
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self._array = array

    def __len__(self) -> int:
        return len(self.ids)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def spans(self, size: int):
        """Runs of documents (first, last + 1) of about ``size`` bytes, one document at least."""
        i, n = 0, len(self)
        while i < n:
            j = int(np.searchsorted(self.offsets, self.offsets[i] + size, "right")) - 1
            j = min(n, max(i + 1, j))
            yield i, j
            i = j


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences of one fixed width."""
    if not len(values):
        return b""
    d = np.diff(values, prepend=values.dtype.type(0)).astype("<u8")
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + d.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(blob: bytes, n: int) -> tuple[np.ndarray, int]:
    """The integers, and how many bytes they took."""
    if not n:
        return np.zeros(0, np.uint64), 0
    width = blob[0]
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, 1).reshape(n, width)
    return np.cumsum(raw.reshape(-1).view("<u8"), dtype=np.uint64), 1 + n * width


def pack_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpack_bits(blob: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at), count=n).astype(bool)


class Split:
    """Sorted unique hashes dealt to partitions of the hash space."""

    def __init__(self, hashes: np.ndarray, partitions: int):
        self.partitions = partitions
        part = (hashes % np.uint64(partitions)).astype(np.int32)
        self.order = np.argsort(part, kind="stable")
        self.bounds = np.searchsorted(part[self.order], np.arange(partitions + 1))
        self.rest = hashes // np.uint64(partitions)

    def parts(self):
        """(partition, positions in the hash array), values ascending in each."""
        for p in range(self.partitions):
            at = self.order[self.bounds[p] : self.bounds[p + 1]]
            if len(at):
                yield p, at

    def marked(self, answers: list[tuple[int, bytes]], plane: int = 0) -> np.ndarray:
        """The answered bits of this plane, at the hashes' positions."""
        out = np.zeros(len(self.order), bool)
        for p, blob in answers:
            at = self.order[self.bounds[p] : self.bounds[p + 1]]
            out[at] = unpack_bits(blob, len(at), plane * ((len(at) + 7) // 8))
        return out


def asks(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    p, g, n, b = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"__p": pa.array(p, pa.int64()), "__g": pa.array(g, pa.int32()), "__n": pa.array(n, pa.int64()), "__blob": pa.array(b, pa.binary())})


def answers(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    g, p, k, b = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"__g": pa.array(g, pa.int32()), "__p": pa.array(p, pa.int64()), "__kind": pa.array(k, pa.int32()), "__blob": pa.array(b, pa.binary())})


def answered(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    return [(r["__p"], r["__blob"]) for r in table.filter(pc.equal(table.column("__kind"), kind)).to_pylist()]


class Sets:
    """What is sent about hashes, and how it is merged and answered.

    Values are ascending; ``columns`` say more about each. ``number`` tells the
    answers of several exchanges apart."""

    number = 0

    def __init__(self, radix: int = RADIX):
        self.radix = radix

    def write(self, values: np.ndarray, columns: list[np.ndarray]) -> bytes:
        raise NotImplementedError

    def read(self, blob: bytes, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        raise NotImplementedError

    def merge(self, values: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Distinct values, their columns, and the place of each input among them."""
        raise NotImplementedError

    def decide(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Bit planes of the answer, where nothing else is known of a value."""
        raise NotImplementedError

    def spread(self, said: list[np.ndarray], merged: list[np.ndarray], columns: list[np.ndarray], place: np.ndarray) -> list[np.ndarray]:
        """Bit planes of the inputs, from those of what they were merged into."""
        return [s[place] for s in said]

    def sent(self, values: np.ndarray, columns: list[np.ndarray], group: int, part: int = 0) -> pa.Table:
        s = Split(values, self.radix)
        return asks([(part * self.radix + p, group, len(at), self.write(s.rest[at], [c[at] for c in columns])) for p, at in s.parts()])

    def _read(self, rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
        read = [self.read(r["__blob"], r["__n"]) for r in rows]
        return np.concatenate([v for v, _ in read]), [np.concatenate(c) for c in zip(*[c for _, c in read], strict=True)]

    def _replies(self, rows: list[dict], planes: list[np.ndarray]) -> pa.Table:
        out, at = [], 0
        for r in rows:
            out.append((r["__g"], r["__p"], self.number, b"".join(pack_bits(x[at : at + r["__n"]]) for x in planes)))
            at += r["__n"]
        return answers(out)


def _last(kind: Sets):
    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        values, columns = kind._read(rows)
        _, merged, place = kind.merge(values, columns)
        return kind._replies(rows, kind.spread(kind.decide(merged), merged, columns, place))

    return answer


def _up(kind: Sets):
    def send(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        values, merged, _ = kind.merge(*kind._read(rows))
        return kind.sent(values, merged, rows[0]["__g"] // kind.radix, rows[0]["__p"])

    return send


def _down(kind: Sets):
    def answer(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return answers([])
        rows = table.to_pylist()
        values, columns = kind._read(rows)
        values, merged, place = kind.merge(values, columns)
        split, said = Split(values, kind.radix), [(p % kind.radix, b) for p, b in answered(reply, kind.number)]
        planes = [split.marked(said, k) for k in range(len(kind.decide(merged)))]
        return kind._replies(rows, kind.spread(planes, merged, columns, place))

    return answer


def levels(total: int, part_bytes: int) -> int:
    """Digits of the hash space, so that a part of it has this many bytes of text."""
    n = 1
    while RADIX**n * part_bytes < total:
        n += 1
    return n


def exchanged(asked: DataFrame, kind: Sets, digits: int) -> DataFrame:
    """Answers to what groups asked, by part and group."""
    if digits == 1:
        return asked.groupBy("__p").applyInArrow(_last(kind), ANSWER)
    several = asked.withColumn("__s", F.floor(F.col("__g") / kind.radix).cast("int"))
    merged = several.groupBy("__p", "__s").applyInArrow(_up(kind), ASK)
    said = exchanged(merged, kind, digits - 1).withColumn("__q", F.floor(F.col("__p") / kind.radix))
    return several.groupBy("__p", "__s").cogroup(said.groupBy("__q", "__g")).applyInArrow(_down(kind), ANSWER)


def keep_fields(docs: DataFrame, keep: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(f"__k{i}", docs.schema[c].dataType, True) for i, c in enumerate(keep)]
