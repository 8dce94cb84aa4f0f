"""Substring dedup over words by fixed-block anchors.

Any window of ``window`` words holds a whole aligned block of
``(window + 1) // 2`` words of the document that has it first. So: index the
non-overlapping reference blocks of every document, probe the index with every
rolling window of block length, extend each hit to the windows around it, and
remove what those maximal repeats cover.

Two exchanges of packed hash sets do this (see ``groups``). In the first, a
group sends the set of its rolling block hashes with a bit for those that are
reference blocks; a hash is a hit if it is a reference block somewhere and two
documents hold it. In the second, a hit is extended word by word as long as the
window there is one that a smaller document has: windows around hits are
compared with the smallest document that holds each, by 96 bits of two word
hashes that share no coefficient. Neighbouring windows that are found so form a
maximal exact repeat. No pairs are made: a passage that a third of all
documents share is one entry per group.

Defined cases: null texts have no words; documents shorter than a window are
kept whole; an empty table gives no rows; a null id sorts first; rows that share
an id, repeated rows among them, count as one document for "smaller id" (so
there are no ties), never remove words from each other, and are spread over
groups; other columns pass through if they are in ``keep``, under any name but
those of the result, and clash with no internal one. Words may have 2 GB, and a
text is held whole in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import groups as g_
from .groups import ASK, G, ID, Sets, Split, Texts
from .hashing import Words, counted, covered, window_hashes

WINDOW = 13
#: Bytes of text whose temporary arrays exist at a time.
STEP = 1 << 20
#: Bits of the hashes in the index; false hits only cost a comparison.
INDEX_BITS = 52
#: Bytes of text that a part of the hash space is laid out for.
PARTITION_BYTES = 18 << 20


class _Group:
    """A group's words and the hashes of its rolling blocks."""

    def __init__(self, table: pa.Table, window: int, twice: bool = False):
        self.table = g_.ordered(table)
        self.texts = t = Texts(self.table)
        self.window, self.block = window, (window + 1) // 2
        parts, seconds, first, at = [], [], [np.zeros(1, np.int64)], 0
        for i, j in t.spans(STEP):
            lo, hi = t.offsets[i], t.offsets[j]
            w = Words(t.data[lo:hi], t.offsets[i : j + 1] - lo, twice)
            parts.append(w.hash)
            seconds += [w.hash2] if twice else []
            first.append(w.first[1:] + at)
            at += len(w.hash)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.second = np.concatenate(seconds) if seconds else None
        self.first = np.concatenate(first)
        self.doc = np.repeat(np.arange(len(t), dtype=np.int32), np.diff(self.first))
        stop = self.first[1:][self.doc]
        here = np.arange(len(self.words))
        self.starts = np.flatnonzero(here + self.block <= stop)
        self.whole = here + window <= stop

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct rolling block hashes, and each start's place among them."""
        h = window_hashes(self.words, self.starts, self.block) >> np.uint64(64 - INDEX_BITS)
        return np.unique(h, return_inverse=True)

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Starts of whole windows that contain a block that was hit."""
        d = np.zeros(len(self.words) + 1, np.int32)
        at = self.starts[hit]
        np.add.at(d, np.maximum(at - (self.window - self.block), 0), 1)
        np.add.at(d, at + 1, -1)
        return np.flatnonzero((np.cumsum(d[:-1]) > 0) & self.whole)

    def longer(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows (two hashes) with their smallest id, and each one's place."""
        a = window_hashes(self.words, at, self.window, 0)
        b = (window_hashes(self.second, at, self.window, 1) >> np.uint64(32)).astype(np.uint32)
        ids = self.texts.ids[self.doc[at]]
        lead, place = _leads(a, b, ids)
        return a[lead], b[lead], ids[lead], place


class _Blocks(Sets):
    """Block hashes: if one is a reference block, and if two documents hold it."""

    def write(self, values, columns):
        return g_.pack_sorted(values) + g_.pack_bits(columns[0]) + g_.pack_bits(columns[1])

    def read(self, blob, n):
        values, used = g_.unpack_sorted(blob, n)
        return values, [g_.unpack_bits(blob, n, used), g_.unpack_bits(blob, n, used + (n + 7) // 8)]

    def merge(self, values, columns):
        h, place, times = np.unique(values, return_inverse=True, return_counts=True)
        block, many = np.zeros(len(h), bool), times > 1
        block[place[columns[0]]] = True
        many[place[columns[1]]] = True
        return h, [block, many], place

    def decide(self, columns):
        return [columns[0] & columns[1]]


class _Windows(Sets):
    """Window hashes with the smallest id; the answer is if a smaller one has it."""

    number = 1

    def write(self, values, columns):
        b, ids = columns
        low = ids.min()
        away = (ids - low).astype("<u8")
        width = max(1, (int(away.max()).bit_length() + 7) // 8)
        return g_.pack_sorted(values) + b.astype("<u4").tobytes() + int(low).to_bytes(8, "little", signed=True) + bytes([width]) + away.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()

    def read(self, blob, n):
        values, used = g_.unpack_sorted(blob, n)
        b = np.frombuffer(blob, "<u4", n, used)
        used += 4 * n
        low, width = int.from_bytes(blob[used : used + 8], "little", signed=True), blob[used + 8]
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, used + 9).reshape(n, width)
        return values, [b, raw.reshape(-1).view("<u8").astype(np.int64) + low]

    def merge(self, values, columns):
        b, ids = columns
        lead, place = _leads(values, b, ids)
        return values[lead], [b[lead], ids[lead]], place

    def decide(self, columns):
        return [np.zeros(len(columns[0]), bool)]

    def spread(self, said, merged, columns, place):
        return [said[0][place] | (merged[1][place] < columns[1])]


def _leads(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct (a, b), ascending, the entry with the least id, and each entry's place."""
    order = np.lexsort((ids, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _index(window: int, blocks: _Blocks):
    def send(table: pa.Table) -> pa.Table:
        x = _Group(table, window)
        h, place = x.blocks()
        aligned = np.zeros(len(h), bool)
        aligned[place[(x.starts - x.first[:-1][x.doc[x.starts]]) % x.block == 0]] = True
        # more than one id holds it, here
        ids = x.texts.ids[x.doc[x.starts]]
        lead = np.zeros(len(h), np.int64)
        lead[place] = ids
        many = np.zeros(len(h), bool)
        many[place[lead[place] != ids]] = True
        return blocks.sent(h, [aligned, many], table.column(G)[0].as_py())

    return send


def _hits(x: _Group, reply: pa.Table, blocks: _Blocks) -> np.ndarray:
    """Starts of the windows to which the group's hits may extend."""
    h, place = x.blocks()
    return x.candidates(Split(h, blocks.radix).marked(g_.answered(reply, blocks.number))[place])


def _extend(window: int, blocks: _Blocks, windows: _Windows):
    def send(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return g_.asks([])
        x = _Group(table, window, twice=True)
        a, b, ids, _ = x.longer(_hits(x, reply, blocks))
        return windows.sent(a, [b, ids], table.column(G)[0].as_py())

    return send


def _remove(window: int, blocks: _Blocks, windows: _Windows, names: list[str]):
    def cut(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: [] for n in names})
        x = _Group(table, window, twice=True)
        at = _hits(x, reply, blocks)
        a, _, ids, place = x.longer(at)
        later = Split(a, windows.radix).marked(g_.answered(reply, windows.number))[place]
        later |= x.texts.ids[x.doc[at]] > ids[place]
        gone = covered(len(x.words), at[later], window)
        n_words = np.diff(x.first)
        n_gone = counted(gone, x.first)
        kept = [_kept(x.texts.bytes_of(i), gone[x.first[i] : x.first[i + 1]]) if n_gone[i] else None for i in range(len(x.texts))]
        t = x.table
        whole = t.column(g_.TEXT).to_pylist()
        texts = [w if k is None else k for w, k in zip(whole, kept, strict=True)]
        out = {ID: t.column(ID), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept": pa.array(texts, pa.binary())}
        return pa.table(out | {n: t.column(n) for n in names if n.startswith("__k")}).select(names)

    return cut


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    """The text without its removed words and the space after each."""
    data = np.frombuffer(text, np.uint8)
    w = Words(data, np.array([0, len(data)]))
    until = np.append(w.start[1:], len(data))
    d = np.zeros(len(data) + 1, np.int8)
    d[w.start[gone]] += 1
    d[until[gone]] -= 1
    return data[np.cumsum(d[:-1], dtype=np.int8) == 0].tobytes()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """A row per document: the id, the ``keep`` columns, ``n_words``,
    ``n_removed`` and ``kept``, the text without the words of windows that a
    document with a smaller id holds. Space between kept words stays."""
    keep = list(keep or [])
    total = g_.text_bytes(docs, text_col)
    n = g_.group_count(docs, total)
    blocks, windows = _Blocks(g_.RADIX), _Windows(g_.RADIX)
    digits = g_.levels(total, PARTITION_BYTES)
    by_group = g_.grouped(docs, id_col, text_col, n, keep)
    hits = g_.exchanged(by_group.groupBy(G).applyInArrow(_index(window, blocks), ASK), blocks, digits)
    wide = by_group.groupBy(G).cogroup(hits.groupBy(G)).applyInArrow(_extend(window, blocks, windows), ASK)
    replies = hits.unionByName(g_.exchanged(wide, windows, digits))
    fields = [T.StructField(ID, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType()), *g_.keep_fields(docs, keep)]
    out = by_group.groupBy(G).cogroup(replies.groupBy(G)).applyInArrow(_remove(window, blocks, windows, [f.name for f in fields]), T.StructType(fields))
    return out.select(g_.shown_id().alias(id_col), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = F.trim(F.regexp_replace("kept", r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))
