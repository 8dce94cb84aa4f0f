"""Suffix-array dedup over bytes by threshold-bounded interval expansion.

A byte goes if a ``window``-byte string that covers it also starts earlier.

* Every window has a minimizer, the least hash of its ``SEED``-byte strings.
  Equal windows have equal minimizers, so runs of windows with one minimizer
  (*segments*) are what is compared, and only with segments of their bucket.
* Groups first ask which minimizers occur twice (see ``groups``); only those
  segments travel. Equal segments are collapsed to the earliest, so copies,
  however many, add one string per group.
* The distinct segments of a bucket are indexed together: suffixes sorted by
  their first ``window`` bytes give a Burrows-Wheeler transform, and breadth
  first backward extension of its intervals sets the common-prefix lengths in
  increasing order, stopping at ``window``. What is left unset are intervals
  of suffixes that share ``window`` bytes; all but the earliest are repeats.
* A bucket with more than ``HOT_SEGMENTS`` distinct segments (a short line that
  a large part of all rows hold) is dealt anew by the hash of whole windows, so
  that it spreads over all partitions. The comparison stays the same.

Defined cases: a null text is empty; texts shorter than a window are kept; an
empty table gives no rows; a null id sorts first; rows that share an id are
ordered by a hash of their text and spread over groups; of repeated rows the
first stays; texts are cut as bytes, at any byte, and held whole in one task;
other columns pass through if they are in ``keep``, under any name but those of
the result, and clash with no internal one.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from . import groups as g_
from .groups import ANSWER, ASK, G, HASH, ID, Sets, Split, Texts
from .hashing import BYTE, counted, covered, mix
from .hashing import WINDOW as ODD

WINDOW = 100
#: Bytes of the strings whose least hash is the minimizer.
SEED = 32
#: Windows whose temporary arrays exist at a time.
STEP = 1 << 20
INDEX_BITS = 52
HOT_SEGMENTS = 20_000
#: Answers that are read at a time.
REPLIES = 20_000
#: Bytes of text for each part of the hash space, and for each task that compares segments.
PARTITION_BYTES = 64 << 20
COMPARE_BYTES = 1 << 20
#: Bytes that are indexed together, buckets whole.
INDEX_BYTES = 1 << 20


def seed_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each position."""
    h, k, step = BYTE[data], 1, 0
    while k < size:
        h = h[:-k] * ODD[0, step] + h[k:]
        k, step = 2 * k, step + 1
    return mix(h)


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    k = 1
    while 2 * k <= size:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (size - k)], h[size - k :]) if size > k else h


def segments(data: np.ndarray, offsets: np.ndarray, window: int, seed: int, inside: bool = True):
    """Runs of windows with one minimizer: first window, number of windows,
    bucket, and with ``inside``, if the minimizing string occurs more than once
    in the run."""
    seeds = window - seed + 1
    firsts, counts, buckets, inner = [], [], [], []
    for s in range(0, len(data) - window + 1, STEP):
        piece = data[s : s + STEP + window - 1]
        h = seed_hashes(piece, seed)
        low = sliding_min(h, seeds)
        n = len(low)
        ends = offsets[1:]
        whole = np.zeros(n + 1, np.int32)
        lo, hi = np.maximum(offsets[:-1] - s, 0), np.minimum(ends - window + 1 - s, n)
        real = hi > lo
        np.add.at(whole, lo[real], 1)
        np.add.at(whole, hi[real], -1)
        whole = np.cumsum(whole[:-1]) > 0
        edge = whole.copy()
        edge[1:] &= ~whole[:-1] | (low[1:] != low[:-1])
        stop = whole.copy()
        stop[:-1] &= ~whole[1:] | (low[1:] != low[:-1])
        a = np.flatnonzero(edge)
        b = np.flatnonzero(stop) + 1
        firsts.append(a + s)
        counts.append(b - a)
        buckets.append(low[a] >> np.uint64(64 - INDEX_BITS))
        # a position is a minimum if its hash is the least of a window that holds it;
        # a run whose stretch has two minima with its value holds that string twice
        twice = np.zeros(len(a), bool)
        if inside and len(a):
            edge_ = np.zeros(seeds - 1, np.uint64)
            at = np.flatnonzero(~sliding_min(~np.concatenate([edge_, low, edge_]), seeds) == h)
            x, y = np.searchsorted(at, a), np.searchsorted(at, b + seeds - 1)
            held = y - x
            begin = np.cumsum(held) - held
            flat = np.arange(int(held.sum())) + np.repeat(x - begin, held)
            twice = np.add.reduceat((h[at[flat]] == np.repeat(low[a], held)).view(np.int8), begin, dtype=np.int32) > 1
        inner.append(twice)
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(buckets), np.concatenate(inner)


class _Group:
    def __init__(self, table: pa.Table, window: int, inside: bool = True):
        self.table = g_.ordered(table)
        self.texts, self.hash = Texts(self.table), self.table.column(HASH).to_numpy()
        self.window = window
        self.first, self.count, self.bucket, self.inner = segments(self.texts.data, self.texts.offsets, window, SEED, inside)
        self.buckets, self.place = np.unique(self.bucket, return_inverse=True)

    def sent(self, reply: pa.Table, kind: _Buckets):
        """Segments to compare, after the first answer: first window, windows,
        bucket, inner, and for each the index of the equal one before it or -1."""
        split, said = Split(self.buckets, kind.radix), g_.answered(reply, kind.number)
        again, hot = (split.marked(said, plane)[self.place] for plane in (0, 1))
        cold = again & ~hot
        first, count, bucket, inner = (x[cold] for x in (self.first, self.count, self.bucket, self.inner))
        if hot.any():
            n = self.count[hot]
            each = np.arange(int(n.sum())) + np.repeat(self.first[hot] - (np.cumsum(n) - n), n)
            raw = self.texts.data.tobytes()
            key = np.array([xxh3_64_intdigest(raw[w : w + self.window]) for w in each.tolist()], np.uint64) >> np.uint64(64 - INDEX_BITS)
            first, count = np.concatenate([first, each]), np.concatenate([count, np.ones(len(each), np.int64)])
            bucket, inner = np.concatenate([bucket, key]), np.concatenate([inner, np.zeros(len(each), bool)])
            order = np.argsort(first, kind="stable")
            first, count, bucket, inner = first[order], count[order], bucket[order], inner[order]
        seen: dict[bytes, int] = {}
        data, w, same = self.texts.data, self.window - 1, np.full(len(first), -1, np.int64)
        raw = data.tobytes()
        for i, (a, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
            j = seen.setdefault(raw[a : a + n + w], i)
            if j != i:
                same[i] = j
        return first, count, bucket, inner, same


class _Buckets(Sets):
    """Buckets: if one occurs again, and how many distinct segments groups have in it."""

    def __init__(self, radix: int, hot: int):
        super().__init__(radix)
        self.hot = hot

    def write(self, values, columns):
        return g_.pack_sorted(values) + g_.pack_bits(columns[0]) + columns[1].astype("<u4").tobytes()

    def read(self, blob, n):
        values, used = g_.unpack_sorted(blob, n)
        return values, [g_.unpack_bits(blob, n, used), np.frombuffer(blob, "<u4", n, used + (n + 7) // 8)]

    def merge(self, values, columns):
        h, place, times = np.unique(values, return_inverse=True, return_counts=True)
        again = times > 1
        again[place[columns[0]]] = True
        return h, [again, np.minimum(np.bincount(place, columns[1], len(h)), 2**31).astype(np.uint32)], place

    def decide(self, columns):
        return [columns[0], columns[1] > self.hot]


def _index(window: int, kind: _Buckets):
    def send(table: pa.Table) -> pa.Table:
        x = _Group(table, window)
        times = np.bincount(x.place, minlength=len(x.buckets))
        data, w = x.texts.data.tobytes(), window - 1
        distinct = np.minimum(times, 255)
        for b in np.flatnonzero(times >= 255):  # few: count their contents
            at = np.flatnonzero(x.place == b)
            distinct[b] = len({data[x.first[i] : x.first[i] + x.count[i] + w] for i in at})
        many = times > 1
        # a repeat inside one run needs no other run
        many[x.place[x.inner]] = True
        return kind.sent(x.buckets, [many, distinct], table.column(G)[0].as_py())

    return send


#: A segment: where it is compared, where it is from, its order, and its bytes.
SEGMENT = "__p long, __g int, __i long, bucket long, id long, hash long, row long, start long, n long, inner boolean, bytes binary"
_SEGMENT = pa.schema([("__p", pa.int64()), ("__g", pa.int32()), *[(c, pa.int64()) for c in ("__i", "bucket", "id", "hash", "row", "start", "n")], ("inner", pa.bool_()), ("bytes", pa.binary())])


def _segments_of(window: int, partitions: int, kind: _Buckets):
    def send(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SEGMENT.empty_table()
        x = _Group(table, window)
        first, count, bucket, inner, same = x.sent(reply, kind)
        at = np.flatnonzero(same < 0)
        first, count, bucket, inner = first[at], count[at], bucket[at].astype(np.int64), inner[at]
        doc = np.searchsorted(x.texts.offsets, first, "right") - 1
        size, data = count + (window - 1), x.texts.data.tobytes()
        body = b"".join([data[a : a + k] for a, k in zip(first.tolist(), size.tolist(), strict=True)])
        ends = np.zeros(len(at) + 1, np.int32)
        np.cumsum(size, out=ends[1:])
        segs = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(body)])
        longs = (at, bucket, x.texts.ids[doc], x.hash[doc], doc, first - x.texts.offsets[doc], count)
        g = np.full(len(at), table.column(G)[0].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(bucket % partitions), pa.array(g), *[pa.array(c.astype(np.int64)) for c in longs], pa.array(inner), segs], schema=_SEGMENT)

    return send


def bounded_suffix_order(text: np.ndarray, bound: int) -> np.ndarray:
    """Positions of ``text`` sorted by at least ``bound`` symbols (prefix doubling)."""
    n = len(text)
    pad = np.zeros(n + 8, np.uint64)
    pad[:n] = text
    key, k = np.zeros(n, np.uint64), 7
    for i in range(k):
        key = (key << np.uint64(9)) | pad[i : n + i]
    order = np.argsort(key, kind="stable")
    while True:
        ranked = key[order]
        new = np.ones(n, np.uint64)
        new[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        if k >= bound or rank[order[-1]] == n:
            return order
        second = np.zeros(n, np.uint64)
        second[: max(0, n - k)] = rank[k:]
        key = (rank << np.uint64(32)) | second
        order = np.argsort(key, kind="stable")
        k *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """Which neighbours in ``order`` share fewer than ``bound`` symbols.

    Entry i is the common prefix of suffixes i - 1 and i if below ``bound``,
    else -1. Intervals of the transform are extended backward one symbol at a
    time, all of one length at once; an interval's upper end fixes the entry
    behind it, at that length, unless a shorter string has fixed it before.
    """
    n = len(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    forward = np.empty(n, np.int64)  # the last-to-first map
    forward[by_symbol] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for length in range(bound):
        size = hi - lo
        at = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        # positions with one symbol in one interval map to one new interval
        key = np.repeat(np.arange(len(lo)), size) * 512 + bwt[at]
        image = forward[at]
        sort = np.argsort(key, kind="stable")
        key = key[sort]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        new_lo = image[sort[edge]]
        new_hi = new_lo + np.diff(np.append(edge, len(key)))
        fresh = lcp[new_hi] < 0
        if length == 0:  # the end of the last interval is fixed from the start
            fresh |= new_hi == n
        lcp[new_hi[fresh]] = np.where(new_hi[fresh] == n, 0, length)
        keep = fresh | (new_hi == n)
        lo, hi = new_lo[keep], new_hi[keep]
        if not len(lo):
            break
    return lcp[:n]


def repeated_windows(segs: list[bytes], ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, window: int, hashes: np.ndarray | None = None) -> list[np.ndarray]:
    """For each segment, which of its windows start earlier in another place."""
    sizes = np.array([len(s) for s in segs])
    at = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(segs), np.int64)
    inside = np.ones(len(text), bool)
    inside[at + sizes] = False
    text[inside] = np.frombuffer(b"".join(segs), np.uint8).astype(np.int64) + 1
    order = bounded_suffix_order(text, window)
    lcp = common_prefixes(text, order, window)
    group = np.cumsum(lcp >= 0)
    seg = np.repeat(np.arange(len(segs)), sizes + 1)
    whole = (np.arange(len(text)) - at[seg]) <= (sizes - window)[seg]
    pos, group = order[whole[order]], group[whole[order]]
    s = seg[pos]
    hashes = np.zeros(len(segs), np.int64) if hashes is None else hashes
    by = np.lexsort((starts[s] + pos - at[s], rows[s], hashes[s], ids[s], group))
    later = np.zeros(len(pos), bool)
    later[by[1:]] = group[by][1:] == group[by][:-1]
    flags = np.zeros(len(text), bool)
    flags[pos] = later
    return [flags[a : a + n - window + 1] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]


def _compare(window: int):
    def answer(table: pa.Table) -> pa.Table:
        segs = table.column("bytes").to_pylist()
        bucket, ids, hashes, rows, starts, count = (table.column(c).to_numpy() for c in ("bucket", "id", "hash", "row", "start", "n"))
        inner = table.column("inner").to_numpy()
        # the earliest of each content stays; the rest is repeated as a whole
        seen: dict[tuple, int] = {}
        of = bucket.tolist()
        for i in np.lexsort((starts, rows, hashes, ids)).tolist():
            seen.setdefault((of[i], segs[i]), i)
        lead = np.array(sorted(seen.values()))
        flags: list[np.ndarray | bool] = [True] * len(segs)  # one value for all windows, or one for each
        lead = lead[np.argsort(bucket[lead], kind="stable")]
        edge = np.flatnonzero(np.concatenate([[True], bucket[lead][1:] != bucket[lead][:-1]]))
        batch: list[int] = []
        size = 0

        def flag(batch: list[int]) -> None:
            i = np.array(batch)
            for k, f in zip(batch, repeated_windows([segs[k] for k in batch], ids[i], rows[i], starts[i], window, hashes[i]) if batch else (), strict=True):
                flags[k] = f

        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(lead)], strict=True):
            of_bucket = lead[a:b].tolist()
            if len(of_bucket) == 1 and not inner[of_bucket[0]]:
                flags[of_bucket[0]] = False
                continue
            batch += of_bucket
            size += sum(len(segs[i]) for i in of_bucket)
            if size >= INDEX_BYTES:
                flag(batch)
                batch, size = [], 0
        flag(batch)
        same = functools.cache(lambda n, value: g_.pack_bits(np.full(n, value)))
        blobs = [same(n, f) if isinstance(f, bool) else g_.pack_bits(f) for n, f in zip(count.tolist(), flags, strict=True)]
        return pa.table({"__g": table.column("__g"), "__p": table.column("__i"), "__kind": pa.array(np.ones(len(blobs), np.int32)), "__blob": pa.array(blobs, pa.binary())})

    return answer


def _cut(window: int, kind: _Buckets, names: list[str]):
    def cut(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: [] for n in names})
        x = _Group(table, window, inside=False)
        first, count, _, _, same = x.sent(reply, kind)
        begin = np.cumsum(count) - count
        later = np.ones(int(count.sum()), bool)  # of equal segments all but the first go
        said = reply.filter(pc.equal(reply.column("__kind"), 1)).combine_chunks()
        if said.num_rows:
            for k in range(0, said.num_rows, REPLIES):
                part = said.slice(k, REPLIES)
                at = part.column("__p").to_numpy()
                bits = np.unpackbits(np.frombuffer(b"".join(part.column("__blob").to_pylist()), np.uint8)).view(bool)
                n, bytes_ = count[at], (count[at] + 7) // 8
                inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                later[inside + np.repeat(begin[at], n)] = bits[inside + np.repeat(8 * (np.cumsum(bytes_) - bytes_), n)]
        at = np.flatnonzero(later)
        windows = at + (first - begin)[np.searchsorted(begin, at, "right") - 1] if len(at) else at
        t = x.texts
        gone = covered(len(t.data), windows, window)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        edge |= gone & _at(t.offsets[:-1], len(gone))
        n_gone = counted(gone, t.offsets)
        kept = [(t.data[a:b][~gone[a:b]] if n else t.data[a:b]).tobytes() for a, b, n in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), n_gone.tolist(), strict=True)]
        out = {ID: x.table.column(ID), "n_bytes": pa.array(np.diff(t.offsets), pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "n_spans": pa.array(counted(edge, t.offsets), pa.int64()), "kept": pa.array(kept, pa.binary())}
        return pa.table(out | {n: x.table.column(n) for n in names if n.startswith("__k")}).select(names)

    return cut


def _at(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[places] = True
    return out[:n]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """A row per document: the id, the ``keep`` columns, ``n_bytes``,
    ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay."""
    if window < SEED:
        raise ValueError(f"a window has {SEED} bytes at least")
    keep = list(keep or [])
    total = g_.text_bytes(docs, text_col)
    n = g_.group_count(docs, total)
    partitions = max(n, math.ceil(total / COMPARE_BYTES))
    by_group = g_.grouped(docs, id_col, text_col, n, keep)
    kind = _Buckets(g_.RADIX, HOT_SEGMENTS)
    again = g_.exchanged(by_group.groupBy(G).applyInArrow(_index(window, kind), ASK), kind, g_.levels(total, PARTITION_BYTES))
    segs = by_group.groupBy(G).cogroup(again.groupBy(G)).applyInArrow(_segments_of(window, partitions, kind), SEGMENT)
    replies = again.unionByName(segs.groupBy("__p").applyInArrow(_compare(window), ANSWER))
    fields = [T.StructField(ID, T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType()), *g_.keep_fields(docs, keep)]
    out = by_group.groupBy(G).cogroup(replies.groupBy(G)).applyInArrow(_cut(window, kind, [f.name for f in fields]), T.StructType(fields))
    return out.select(g_.shown_id().alias(id_col), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "n_spans", "kept")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
