"""Media columns: ISO media containers written and probed without decoding.

:func:`mux` stores bytes losslessly as 8-bit video samples (grey frames of
``FRAME`` bytes, codec ``raw ``) in an ISO base media file. :func:`probe` walks
the nested boxes of such a file, decodes its sample tables, and gives codec,
time scale, duration, and the byte ranges of keyframes; the payload itself is
only read by :func:`sample_bytes`, through those tables. Samples of movie
fragments (``moof``) follow those of the tables, by the defaults of ``trex`` and
``tfhd`` and the runs of ``trun``.

Defined cases: a null payload is empty and stored as one frame of padding; an
empty table gives no rows; equal payloads, repeated rows among them, give equal
files, so there are no ties; a payload of any length is one file, held whole in
one task; other columns pass through, whatever their names, but one that has
the name of a result is replaced by it. A file without a movie box, or with a
box that overruns its parent, has no tracks; boxes nested deeper than ``DEPTH``
are not entered; a track without a sync-sample box has only keyframes, as the
format says (that of raw frames is one); a table that is cut short ends where
its bytes end; chunks of no samples have none; an unknown duration is that of
the samples. A fragment run ends where its next sample would leave the file,
and samples of fragments are no more than the file has bytes; a fragment of a
track that the movie box does not have is passed over.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a frame: 32 x 18 grey samples of 8 bits.
WIDTH, HEIGHT = 32, 18
FRAME = WIDTH * HEIGHT
PAD = b"\xff"
TIME_SCALE, FRAME_TIME = 24_000, 1_000
#: Frames of a chunk.
CHUNK = 24
#: Boxes inside boxes up to which files are walked; the format needs some ten.
DEPTH = 64
#: Flag and form of the optional fields of a track fragment's header, in order.
TFHD_FIELDS = ((0x1, ">Q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I"))
#: Flags of the fields of a run's samples, in order: duration, size, flags, composition offset.
TRUN_FIELDS = (0x100, 0x200, 0x400, 0x800)
#: Of a fragment whose data count from its ``moof``, and of a sample that is no keyframe.
BASE_IS_MOOF, NOT_SYNC = 0x20000, 0x10000
#: Boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(payload: bytes) -> bytes:
    """The payload with 255s up to a positive multiple of a frame."""
    return payload + PAD * (-len(payload) % FRAME or (0 if payload else FRAME))


def _box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def _full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *body)


def _mdat_header(size: int) -> bytes:
    return struct.pack(">I4s", 8 + size, b"mdat") if size + 8 < 2**32 else struct.pack(">I4sQ", 1, b"mdat", 16 + size)


def mux(payload: bytes) -> bytes:
    """An ISO media file of the padded payload, one sample per frame."""
    data = padded(payload)
    frames = len(data) // FRAME
    chunks = -(-frames // CHUNK)
    duration = frames * FRAME_TIME
    full, rest = divmod(frames, CHUNK)
    runs = ([(1, CHUNK, 1)] if full else []) + ([(full + 1, rest, 1)] if rest else [])
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    header = _mdat_header(len(data))
    first = len(ftyp) + len(header)
    offsets = first + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * FRAME)
    wide = int(offsets[-1]) >= 2**32
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1),
        b"\x04grey".ljust(32, b"\0"), struct.pack(">Hh", 40, -1),
    )
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, FRAME_TIME)),
        _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    times = struct.pack(">QQ", 0, 0)
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
    mdia = _box(b"mdia", _full(b"mdhd", times, struct.pack(">IQI", TIME_SCALE, duration, 0x55C40000), version=1), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
    tkhd = _full(b"tkhd", times, struct.pack(">IIQ", 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), version=1, flags=7)
    mvhd = _full(b"mvhd", times, struct.pack(">IQ", TIME_SCALE, duration), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    return b"".join((ftyp, header, data, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


def boxes(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, start, start of body, end of body) of every box, depth first."""
    open_: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while open_:
        at, end, path = open_.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                continue
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            continue
        here = (*path, kind)
        yield here, at, at + head, at + size
        open_.append((at + size, end, path))
        if kind in CONTAINERS and len(here) < DEPTH:
            open_.append((at + head, at + size, here))


@dataclass
class Track:
    codec: str = ""
    time_scale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def key_ranges(self) -> list[tuple[int, int]]:
        """Byte offset and length of each keyframe."""
        return list(zip(self.offsets[self.keyframes].tolist(), self.sizes[self.keyframes].tolist(), strict=True))


def _entries(data: memoryview, at: int, end: int, dtype: str, width: int = 1) -> np.ndarray:
    """A counted table, as far as its bytes go."""
    if at + 4 > end:
        return np.zeros((0, width), np.int64)
    n = struct.unpack_from(">I", data, at)[0]
    step = np.dtype(dtype).itemsize * width
    n = min(n, (end - at - 4) // step)
    return np.frombuffer(data, dtype, n * width, at + 4).astype(np.int64).reshape(n, width)


def _sampled(data: memoryview, tables: dict[bytes, tuple[int, int]]) -> int:
    """Duration of the samples that a track's tables give."""
    if b"stts" not in tables:
        return 0
    times = _entries(data, tables[b"stts"][0] + 4, tables[b"stts"][1], ">u4", 2)
    return min(sum(n * each for n, each in times.tolist()), 2**63 - 1)


def _track(data: memoryview, tables: dict[bytes, tuple[int, int]]) -> Track:
    t = Track()
    if b"mdhd" in tables:
        at, end = tables[b"mdhd"]
        wide = end > at and data[at] == 1
        if at + (32 if wide else 20) <= end:
            t.time_scale, t.duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
            if t.duration >= (2**63 if wide else 2**32 - 1):
                t.duration = _sampled(data, tables)
    if b"stsd" in tables and tables[b"stsd"][0] + 16 <= tables[b"stsd"][1]:
        t.codec = bytes(data[tables[b"stsd"][0] + 12 : tables[b"stsd"][0] + 16]).decode("latin-1").strip()
    if b"stsz" in tables and tables[b"stsz"][0] + 12 <= tables[b"stsz"][1]:
        at, end = tables[b"stsz"]
        same, n = struct.unpack_from(">II", data, at + 4)
        t.sizes = np.full(min(n, len(data) // max(same, 1)), same, np.int64) if same else _entries(data, at + 8, end, ">u4")[:, 0]
    at_chunk = np.zeros(0, np.int64)
    for kind, dtype in ((b"stco", ">u4"), (b"co64", ">u8")):
        if kind in tables:
            at_chunk = _entries(data, tables[kind][0] + 4, tables[kind][1], dtype)[:, 0]
    if b"stsc" in tables and len(at_chunk) and len(t.sizes):
        runs = _entries(data, tables[b"stsc"][0] + 4, tables[b"stsc"][1], ">u4", 3)
        if len(runs):
            first = np.clip(runs[:, 0] - 1, 0, len(at_chunk))
            each = np.repeat(runs[:, 1], np.diff(np.append(first, len(at_chunk))).clip(0))
            each = np.minimum(each, len(t.sizes))
            chunk = np.repeat(np.arange(len(each)), each)[: len(t.sizes)]
            t.sizes = t.sizes[: len(chunk)]
            before = np.cumsum(t.sizes) - t.sizes
            t.offsets = at_chunk[chunk] + before - before[np.searchsorted(chunk, chunk)]
    n = len(t.offsets)
    t.sizes = t.sizes[:n]
    if b"stss" in tables:
        keys = _entries(data, tables[b"stss"][0] + 4, tables[b"stss"][1], ">u4")[:, 0] - 1
        t.keyframes = keys[(keys >= 0) & (keys < n)]
    else:
        t.keyframes = np.arange(n)
    return t


@dataclass
class _Run:
    """Samples of a fragment that lie one behind another."""

    track: int
    offsets: np.ndarray
    sizes: np.ndarray
    sync: np.ndarray
    #: decode time of the first, if it is stated, and of all together
    begin: int | None
    duration: int


def _runs(data: memoryview, parts: list[tuple[bytes, int, int, int]], defaults: dict[int, tuple[int, ...]]) -> Iterator[_Run]:
    """The runs of all fragments, from their boxes in the order of the file."""
    moof = base = after = held = 0
    track = begin = None
    normal: list[int] = [0, 0, 0]
    for kind, start, at, end in parts:
        if kind == b"moof":
            moof = after = start
        elif kind == b"traf":
            track = begin = None
        elif kind == b"tfhd" and at + 8 <= end:
            flags, track = struct.unpack_from(">II", data, at)
            given, p = {}, at + 8
            for bit, form in TFHD_FIELDS:
                if flags & bit and p + struct.calcsize(form) <= end:
                    given[bit] = struct.unpack_from(form, data, p)[0]
                    p += struct.calcsize(form)
            # without a base, the first counts from its moof and others from the end of the data before them
            base = after = given.get(0x1, moof if flags & BASE_IS_MOOF else after)
            normal = [given.get(bit, d) for bit, d in zip((0x8, 0x10, 0x20), defaults.get(track, (0, 0, 0)), strict=True)]
        elif kind == b"tfdt" and at + 4 < end:
            form = ">Q" if data[at] else ">I"
            begin = struct.unpack_from(form, data, at + 4)[0] if at + 4 + struct.calcsize(form) <= end else None
        elif kind == b"trun" and track is not None and at + 8 <= end:
            flags, n = struct.unpack_from(">II", data, at)
            p = at + 8 + 4 * bool(flags & 0x1) + 4 * bool(flags & 0x4)
            if p > end:
                continue
            if flags & 0x1:
                after = base + struct.unpack_from(">i", data, at + 8)[0]
            fields = [bit for bit in TRUN_FIELDS if flags & bit]
            fits = (end - p) // (4 * len(fields)) if fields else len(data) // max(normal[1], 1)
            n = min(n, fits, len(data) - held)
            if n <= 0 or not 0 <= after <= len(data):
                continue
            table = np.frombuffer(data, ">u4", n * len(fields), p if fields else 0).astype(np.int64).reshape(n, len(fields))
            times, sizes, marks = (table[:, fields.index(bit)] if bit in fields else np.full(n, d, np.int64) for bit, d in zip(TRUN_FIELDS, normal, strict=False))
            if flags & 0x4:
                marks = marks.copy()
                marks[0] = struct.unpack_from(">I", data, p - 4)[0]
            ends = after + np.cumsum(sizes)
            n = int(np.searchsorted(ends, len(data), "right"))
            held += n
            yield _Run(track, (ends - sizes)[:n], sizes[:n], marks[:n] & NOT_SYNC == 0, begin, int(times[:n].sum()))
            after, begin = int(ends[-1]), None


def probe(media: bytes) -> list[Track]:
    """The tracks of a file, from its boxes alone."""
    data, tracks, tables = memoryview(media), [], None
    parts: list[tuple[bytes, int, int, int]] = []
    defaults: dict[int, tuple[int, ...]] = {}
    for path, start, at, end in boxes(data):
        if path[-1] == b"trak":
            tables = {}
            tracks.append(tables)
        elif tables is not None and b"trak" in path:
            tables[path[-1]] = (at, end)
        elif path[-1] == b"trex" and at + 24 <= end:
            track, _, *normal = struct.unpack_from(">5I", data, at + 4)
            defaults[track] = tuple(normal)
        elif b"moof" in path:
            parts.append((path[-1], start, at, end))
    found = [_track(data, t) for t in tracks]
    if parts:
        _append(data, found, tracks, list(_runs(data, parts, defaults)))
    return found


def _append(data: memoryview, found: list[Track], tracks: list[dict[bytes, tuple[int, int]]], runs: list[_Run]) -> None:
    """Each track's samples of fragments behind those of its tables."""
    of: dict[int, list[_Run]] = {}
    for r in runs:
        of.setdefault(r.track, []).append(r)
    for t, tables in zip(found, tracks, strict=True):
        at, end = tables.get(b"tkhd", (0, 0))
        at_id = at + (20 if end > at and data[at] == 1 else 12)
        mine = of.get(struct.unpack_from(">I", data, at_id)[0], []) if at_id + 4 <= end else []
        if not mine:
            continue
        sync = np.concatenate([r.sync for r in mine])
        t.keyframes = np.concatenate([t.keyframes, len(t.offsets) + np.flatnonzero(sync)])
        t.sizes = np.concatenate([t.sizes, *[r.sizes for r in mine]])
        t.offsets = np.concatenate([t.offsets, *[r.offsets for r in mine]])
        now = _sampled(data, tables)
        for r in mine:
            now = (now if r.begin is None else r.begin) + r.duration
        t.duration = min(max(t.duration, now), 2**63 - 1)


def sample_bytes(media: bytes, track: Track) -> bytes:
    """The stored payload, sample by sample; neighbours are read together."""
    if not len(track.offsets):
        return b""
    cut = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    starts = track.offsets[np.concatenate([[0], cut])]
    ends = (track.offsets + track.sizes)[np.concatenate([cut - 1, [len(track.offsets) - 1]])]
    return b"".join(media[max(a, 0) : max(b, 0)] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))  # past 2^63 is negative


def with_media(docs: DataFrame, text_col: str, out: str = "media") -> DataFrame:
    """``docs`` with the text stored as a media file in a binary column ``out``,
    which replaces the text and any column of that name."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                files = [mux(x or b"") for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(files, pa.binary())], names=part.schema.names)

    kept = [f for f in docs.schema.fields if f.name not in (text_col, out)]
    # columns by place, so that no name can clash
    rows = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{text_col}`").cast("binary").alias("payload"))
    return rows.mapInArrow(store, rows.schema).toDF(*[f.name for f in kept], out)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, time_scale long, duration long, samples long, luma_sum long, key_ranges array<struct<offset:long,length:long>>"


def with_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """What the stored files' boxes and samples say, in place of the files.

    A null file has null features; a file without tracks has no codec, a
    duration of 0 and an empty payload.
    """
    names = [n.split()[0] for n in FEATURES.split(", ")]
    kept = [c for c in media.columns if c != media_col and c not in names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("time_scale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("luma_sum", pa.int64()), ("key_ranges", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))])
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for x in part.column(part.schema.get_field_index(media_col)):
                    rows.append({} if not x.is_valid else _features(x.as_buffer().to_pybytes()))
                made = pa.RecordBatch.from_pylist(rows, schema=schema)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], *made.columns], names=[*kept, *names])

    schema = T.StructType([media.schema[c] for c in kept] + T._parse_datatype_string(FEATURES).fields)
    return media.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{media_col}`")).mapInArrow(read, schema)


def _features(media: bytes) -> dict:
    tracks = probe(media)
    t = tracks[0] if tracks else Track()
    payload = sample_bytes(media, t)
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "codec": t.codec, "time_scale": t.time_scale,
        "duration": t.duration, "samples": len(t.sizes), "luma_sum": int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)), "key_ranges": [{"offset": a, "length": n} for a, n in t.key_ranges],
    }


def op2_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    x = with_features(with_media(docs, "text"))
    told = {"codec": F.col("codec"), "scale": F.col("time_scale"), "duration": F.col("duration"), "samples": F.col("samples"), "luma": F.col("luma_sum"), "keys": F.size("key_ranges"), "first": F.get("key_ranges", F.lit(0))["offset"], "keybytes": F.aggregate("key_ranges", F.lit(0).cast("long"), lambda n, r: n + r["length"])}
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in told.items()])
    return x.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
