"""The remaining operators against brute force, round trips and held-out labels."""

import hashlib
import itertools
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from basalt.llm import bpe, fingerprint, licenses, media, packing, quality, warc
from basalt.llm.storage import durable, new_folder

from ..oracle import connect, expected, rows_of

SF = "/root/testdata/sf0.001"


# media --------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 24 * 576, 24 * 576 + 1, 100_000])
def test_media_round_trip(n):
    payload = random.Random(n).randbytes(n)
    file = media.mux(payload)
    (track,) = media.probe(file)
    assert media.sample_bytes(file, track) == media.padded(payload)
    assert (track.codec, track.duration) == ("raw", len(media.padded(payload)) // 576 * 1000)
    assert all(file[a : a + k] == media.padded(payload)[i * 576 :][:576] for i, (a, k) in enumerate(track.key_ranges)) and len(track.key_ranges) == len(track.sizes)


def test_media_damaged():
    file = media.mux(bytes(5000))
    rng = random.Random(1)
    for _ in range(300):
        bad = bytearray(file[: rng.randint(0, len(file))])
        for _ in range(rng.randint(0, 4)):
            if bad:
                bad[rng.randrange(len(bad))] = rng.randrange(256)
        for t in media.probe(bytes(bad)):
            media.sample_bytes(bytes(bad), t)
    assert media.probe(b"") == [] and media.probe(b"moov") == []


def test_media_variants():
    """Sizes of each sample, runs of chunks, and no sync table."""
    b, full = media._box, media._full
    sizes = [3, 5, 2, 7, 1]
    u4 = lambda *x: np.array(x, ">u4").tobytes()
    data = b"abcdefgh" + b"ijklmnopqr"
    body = b(b"mdat", data)
    table = b(b"stbl", full(b"stsz", u4(0, 5), u4(*sizes)), full(b"stsc", u4(2, 1, 2, 1, 2, 3, 1)), full(b"stco", u4(2, 8, 16)))
    file = body + b(b"moov", b(b"trak", b(b"mdia", b(b"minf", table))))
    (t,) = media.probe(file)
    assert media.sample_bytes(file, t) == data and t.keyframes.tolist() == [0, 1, 2, 3, 4]
    assert t.offsets.tolist() == [8, 11, 16, 18, 25]


def test_media_columns(docs, rows, empty):
    got = media.with_features(media.with_media(docs, "text")).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.payload_sha256, r.tail_crc32) for r in got) == Counter((r[0], hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for r in rows for p in [media.padded((r[1] or "").encode())])
    assert media.with_features(media.with_media(empty, "text")).count() == 0


def test_media_odd_boxes():
    b, full = media._box, media._full
    u4 = lambda *x: np.array(x, ">u4").tobytes()
    table = b(b"stbl", full(b"stsz", u4(4, 2)), full(b"stsc", u4(1, 1, 0, 1)), full(b"stco", u4(1, 8)))
    (t,) = media.probe(b(b"mdat", b"abcdefgh") + b(b"moov", b(b"trak", b(b"mdia", b(b"minf", table)))))
    assert len(t.offsets) == len(t.sizes) == 0 and media.sample_bytes(b"", t) == b""
    deep = b""
    for _ in range(5000):
        deep = b(b"moov", deep)
    assert media.probe(deep) == []


def fragmented():
    """A file of two tracks in fragments, and each track's payload, sizes, keyframes and duration."""
    b, f = media._box, media._full
    u = lambda *x: struct.pack(f">{len(x)}I", *x)

    def trak(i, wide):
        entry = b(b"avc1" if i == 1 else b"mp4a", bytes(8))
        tkhd = f(b"tkhd", bytes(16) if wide else bytes(8), u(i, 0), version=int(wide))
        mdhd = f(b"mdhd", struct.pack(">QQIQ", 0, 0, 1000, 2**64 - 1), bytes(4), version=1) if wide else f(b"mdhd", bytes(8), u(1000, 0, 0))
        stbl = b(b"stbl", f(b"stsd", u(1), entry), f(b"stts", u(0)), f(b"stsc", u(0)), f(b"stsz", u(0, 0)), f(b"stco", u(0)))
        return b(b"trak", tkhd, b(b"mdia", mdhd, b(b"minf", stbl)))

    mvex = b(b"mvex", f(b"trex", u(1, 1, 40, 5, media.NOT_SYNC)), f(b"trex", u(2, 1, 20, 3, 0)))
    head = b(b"ftyp", b"iso5") + b(b"moov", trak(1, False), trak(2, True), mvex)

    def first(size):  # sizes and flags of each sample; the second track counts on from the first one's data
        one = b(b"traf", f(b"tfhd", u(1), flags=media.BASE_IS_MOOF), f(b"tfdt", u(0)), f(b"trun", u(3), struct.pack(">i", size + 8), u(4, 0), u(6, media.NOT_SYNC), u(1, 0), flags=0x601))
        two = b(b"traf", f(b"tfhd", u(2)), f(b"trun", u(2)), f(b"trun", u(1), u(9, 7), flags=0x300))
        return b(b"moof", f(b"mfhd", u(1)), one, two)

    def second(at):  # a base from the start of the file, sizes by default, the first sample a keyframe
        one = b(b"traf", f(b"tfhd", u(1), struct.pack(">Q", at), u(50, 2), flags=0x19), f(b"tfdt", struct.pack(">Q", 500), version=1), f(b"trun", u(2), struct.pack(">i", 0), u(0), flags=0x5))
        return b(b"moof", f(b"mfhd", u(2)), one)

    x = first(len(first(0)))
    file = head + x + b(b"mdat", b"aaaabbbbbbc" + b"dddeeefffffff")
    y = second(len(file) + len(second(0)) + 8)
    file += y + b(b"mdat", b"gghh")
    return file, [(b"aaaabbbbbbcgghh", [4, 6, 1, 2, 2], [0, 2, 3], 600), (b"dddeeefffffff", [3, 3, 7], [0, 1, 2], 49)]


def test_media_fragments(spark):
    file, expected = fragmented()
    tracks = media.probe(file)
    assert [t.codec for t in tracks] == ["avc1", "mp4a"]
    for t, (payload, sizes, keys, duration) in zip(tracks, expected, strict=True):
        assert (media.sample_bytes(file, t), t.sizes.tolist(), t.keyframes.tolist(), t.duration) == (payload, sizes, keys, duration)
        assert [file[a : a + n] for a, n in t.key_ranges] == [file[a : a + n] for a, n in zip(t.offsets[keys].tolist(), [sizes[k] for k in keys], strict=True)]
    rng = random.Random(8)
    damaged = [file[:n] for n in range(len(file))]
    for _ in range(3000):
        bad = bytearray(file)
        for _ in range(rng.choice([1, 2, 8])):
            bad[rng.randrange(len(bad))] = rng.choice([0, 1, 127, 255, rng.randrange(256)])
        damaged.append(bytes(bad))
    for x in damaged:
        for t in media.probe(x):
            assert len(t.sizes) == len(t.offsets) <= 4 * len(x) and 0 <= t.duration < 2**63
    unknown = media.mux(b"x" * 1000).replace(struct.pack(">IQ", media.TIME_SCALE, 2000) + bytes.fromhex("55c40000"), struct.pack(">IQ", media.TIME_SCALE, 2**64 - 1) + bytes.fromhex("55c40000"))
    got = media.with_features(spark.createDataFrame([(1, bytearray(file)), (2, bytearray(unknown))], "i int, media binary")).orderBy("i").collect()
    assert [(r.codec, r.samples, r.duration) for r in got] == [("avc1", 5, 600), ("raw", 2, 2000)]


def test_media_any_column_names(spark):
    df = spark.createDataFrame([("a", "b", "c", "t")], "`__payload` string, `media` string, `c0` string, `text` string")
    got = media.with_features(media.with_media(df, "text"))
    assert got.columns[:2] == ["__payload", "c0"] and got.first().payload_bytes == 576


def test_media_query(spark):
    got = {r.doc_id: r for r in media.op2_media(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw = (d.text or "").encode()
        pad, r, file = media.padded(raw), got[d.doc_id], media.mux(raw)
        n = len(pad) // 576
        first = file.index(b"mdat") + 4
        assert tuple(r) == (d.doc_id, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]), len(file), hashlib.sha256(file).hexdigest(), f"codec=raw;scale=24000;duration={n * 1000};samples={n};luma={sum(pad)};keys={n};first={first};keybytes={len(pad)}")


# licences -----------------------------------------------------------------------

MIT = """// Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
// documentation files (the "Software"), to deal in the Software without restriction.
//
// The above copyright notice and this permission notice shall be included in
// all copies or substantial portions of the Software.
//
// THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice.
2. Redistributions in binary form must reproduce the above copyright notice.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS WARRANTIES ARE DISCLAIMED."""
ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.\n"


@pytest.mark.parametrize(
    "text, found",
    [
        ("", []), (MIT, ["MIT"]), (BSD.format(ENDORSE), ["BSD-3-Clause"]), (BSD.format(""), ["BSD-2-Clause"]),
        (MIT + "\n\n" + BSD.format("") + "\n\n" + MIT, ["MIT", "BSD-2-Clause", "MIT"]),
        ("no end mark\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("x. This work is licensed under the GNU General Public Licence, version 3.", ["GPL-3.0"]),
        ("Released under\nthe MIT License.\nLicensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("# SPDX-License-Identifier: Apache-2.0\nimport x", ["APACHE-2.0"]),
        ("see the licence for details.", []), ("Redistribution and use in source and binary forms, with or without modification, are permitted.", []),
    ],
)
def test_licenses(text, found):
    assert licenses.matched(licenses.recognised(text)) == found


GNU = """{c} This {what} is free software{a} you can redistribute it and/or modify
{c} it under the terms of the GNU {kind}General Public License as published by
{c} the Free Software Foundation{b} either version {v} of the License, or
{c} (at your option) any later version.
{c}
{c} This {what} is distributed in the hope that it will be useful,
{c} but WITHOUT ANY WARRANTY; without even the implied warranty of
{c} MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{c} GNU {kind}General Public License for more details.
"""
MPL = """{c} This Source Code Form is subject to the terms of the Mozilla Public
{c} License, v. 2.0. If a copy of the MPL was not distributed with this
{c} file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


@pytest.mark.parametrize("c", ["", " *", "#", "//"])
def test_license_headers_with_inner_end_marks(c):
    for what, a, b, kind, v, name in (
        ("program", ";", ";", "", "2", "GPL-2.0-or-later"), ("program", ":", ",", "", "3", "GPL-3.0-or-later"), ("library", ";", ";", "Lesser ", "2.1", "LGPL-2.1-or-later"),
        ("program", ":", ",", "Lesser ", "3", "LGPL-3.0-or-later"), ("program", ":", ",", "Affero ", "3", "AGPL-3.0-or-later"),
    ):
        ids = licenses.recognised(GNU.format(c=c, what=what, a=a, b=b, kind=kind, v=v))
        assert ids[0][0] == "gpl-header" and licenses.matched(ids) == [name]
    assert licenses.recognised(MPL.format(c=c)) == [("mpl-ref", "")] and licenses.matched([("mpl-ref", "")]) == ["MPL-2.0"]
    flat = " ".join(GNU.format(c="", what="program", a=";", b=";", kind="", v="2").split())
    assert licenses.matched(licenses.recognised(flat)) == ["GPL-2.0-or-later"]
    assert licenses.matched(licenses.recognised("This tool is free software; released under the MIT License.")) == ["MIT"]


def test_license_sentences_wrapped_over_many_lines():
    narrow = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    for head in ("", "A title\n", "Copyright (c) 2020 The Authors\n", "A title\nCopyright 2020 The Authors\n"):
        for n in (1, 2, 3, 9):
            ids = lambda t: [k for k, _ in licenses.recognised(head + narrow(t, n)) if k != "notice"]  # noqa: B023,E731
            assert ids(notice) == ["mit-notice"]
            assert ids(ENDORSE.removeprefix("3. ")) == ["bsd-endorse"]
            assert licenses.matched(licenses.recognised(head + narrow(GNU.format(c="", what="program", a=";", b=";", kind="", v="2"), n))) == ["GPL-2.0-or-later"]
    assert [k for k, _ in licenses.recognised("Copyright 2020 A\n" + "row of a table\n" * 20 + "Released under the MIT License")] == ["notice", "mit-ref"]
    assert licenses.recognised("our license\n" + "cell\n" * 50) == [(licenses.UNKNOWN, "")]


APACHE_TEXT = """Apache License
Version 2.0, January 2004
http://www.apache.org/licenses/

TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of the Work.

3. Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use the Work.

4. Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
"""
GPL_TEXT = """GNU GENERAL PUBLIC LICENSE
Version 3, 29 June 2007

Copyright (C) 2007 The Foundation
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.

The GNU General Public License is a free, copyleft license for software and other kinds of works.
"""


def test_license_full_texts():
    for text, name in ((APACHE_TEXT, "Apache-2.0"), (ZLIB, "Zlib"), (GPL_TEXT, "GPL-3.0")):
        assert licenses.matched(licenses.recognised(text)) == [name]
        assert licenses.matched(licenses.recognised("\n".join(f" * {x}" for x in text.split("\n")))) == [name]


def test_prose_is_not_about_licensing():
    for text in ("Lunch is provided.", "They did what the others do.", "Both copies of the work were lost.", "The origin of this software is a mystery."):
        assert licenses.recognised(text) == []


def test_license_rules_are_contiguous():
    ids = lambda *k: [(x, "") for x in k]
    assert licenses.matched(ids("mit-grant", "notice", licenses.UNKNOWN, "mit-notice", "mit-warranty", "mit-liability")) == ["MIT"]
    assert licenses.matched(ids("bsd-grant", "bsd-source", "mit-grant", "bsd-binary", "bsd-warranty")) == []
    assert licenses.matched(ids("isc-grant", "mit-ref", "isc-warranty")) == ["MIT"]


def test_license_query(spark):
    """The query against the scan of each text on its own."""
    got = {r.doc_id: r for r in licenses.op4_license_scan(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = licenses.recognised(d.text or "")
        names, keys = licenses.matched(ids), [k for k, _ in ids]
        assert tuple(got[d.doc_id]) == (d.doc_id, ",".join(names), ">".join(keys), len(names), keys.count(licenses.UNKNOWN))


def test_license_columns(docs, rows, empty, spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(1, MIT), (2, None), (3, "a license we do not know.")], "doc_id long, text string")).collect()}
    assert got[1].licenses == ["MIT"] and got[2].licenses == [] and got[3].sentences == [licenses.UNKNOWN]
    assert licenses.scan_licenses(docs).count() == len(rows) and licenses.scan_licenses(empty).count() == 0


def test_license_lines_of_the_tables(spark):
    """Every planted statement is found, in its own document, and nothing else."""
    known = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    got = {r.doc_id: r.licenses.split(",") if r.licenses else [] for r in licenses.op4_license_scan(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        stated = [known[line] for line in r.text.split("\n") if line in known]
        assert [x for x in got[r.doc_id] if x in known.values()] == stated


# WARC ---------------------------------------------------------------------------


def test_warc_query(spark):
    assert rows_of(warc.op5_warc(spark, SF)) == expected(connect(SF), warc.ORACLE_SQL)


def test_warc_cases(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    long = "payload " * 20
    rows = [(4, "u\r\nX: y", inner * 3), (2, "u", long), (9, "u", long), (9, "u", long), (None, "u", "short"), (3, "u", "short"), (5, None, None), (6, "", ""), (1, "u", long + inner), (7, "u", "WARC/1.1\r\n" * 50)]
    folder = new_folder(spark, "warc")
    warc.write_warc(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), "page_id", "html"), folder)
    got = warc.read_warc(spark, folder, payloads=True).collect()
    null = -(2**63)
    want = Counter((null if i is None else i, "revisit" if (i, h) == (9, long) else "response", 2 if (i, h) == (9, long) else None, b"" if (i, h) == (9, long) else (h or "").encode()) for i, _, h in rows)
    assert Counter((r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    assert {(r.page_id, r.payload_bytes) for r in warc.resolved(warc.read_warc(spark, folder)).collect()} == {(null if i is None else i, len((h or "").encode())) for i, _, h in rows}


def test_warc_no_pages(spark):
    folder = new_folder(spark, "warc")
    warc.write_warc(warc.with_revisits(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "html"), folder)
    assert warc.resolved(warc.read_warc(spark, folder)).count() == 0


def test_warc_marks_in_linear_time():
    for filler in (b"WARC/1.0\r\n", b"WARC/1.0\r\n\r\n\r\n", b"WARC/1.0\r\nContent-Length: 1\r\n\r\n\r\n\r\n"):
        data = b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % (len(filler) * 300_000) + filler * 300_000 + b"\r\n\r\n"
        began = time.process_time()
        edges = np.array(list(warc.candidates(data)), np.int64).reshape(-1, 2)
        assert warc.reached(edges[:, 0], edges[:, 1]).tolist() == [0] and time.process_time() - began < 20


def test_warc_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", (100, 1000))
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = [(i, "u", "x" * n) for i, n in enumerate([50] * 45 + [500] * 7 + [5000] * 2)]
    folder = new_folder(spark, "warc")
    warc.write_warc(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), "page_id", "html"), folder)
    got = warc.read_warc(spark, folder)
    assert got.count() == len(rows)
    assert sorted(r["count"] for r in got.groupBy("path").count().collect()) == sorted([20, 20, 5, 2, 2, 2, 1, 1, 1])


def test_warc_revisit_of_nothing(spark):
    records = spark.createDataFrame([("p", 0, "revisit", 5, 4, "ab", 0, "00")], "path string, offset long, record_type string, page_id long, refers_to long, declared_digest string, payload_bytes long, payload_digest string")
    assert tuple(warc.resolved(records).first()) == (5, None, "ab", "revisit", 4)


@pytest.mark.parametrize("seed", range(30))
def test_pointer_jumping(seed):
    rng = np.random.default_rng(seed)
    offsets = np.unique(np.append(rng.integers(0, 400, rng.integers(1, 60)), 0))
    after = np.where(rng.random(len(offsets)) < 0.1, -1, np.append(rng.permutation(offsets), 500)[: len(offsets)])
    shuffled = rng.permutation(len(offsets))
    walk, at, step = [], 0, dict(zip(offsets.tolist(), after.tolist(), strict=True))
    while at in step and step[at] > at:
        walk.append(at)
        at = step[at]
    got = warc.reached(offsets[shuffled], after[shuffled]).tolist()
    assert got == [x for x in walk] or (got[:-1] == walk and 0 <= step[got[-1]] <= got[-1])


# packing ------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(100))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    lengths, counts, k = sorted(rng.sample(range(60), n)), [rng.randint(1, 9) for _ in range(n)], rng.randint(1, 5)
    size = lambda b: sum(min(x for x in b if x >= n) * c for n, c in zip(lengths, counts, strict=True))
    got = packing.optimal_bounds(lengths, counts, k)
    assert len(got) <= k and got[-1] == lengths[-1]
    assert size(got) == min(size([*c, lengths[-1]]) for r in range(k) for c in itertools.combinations(lengths[:-1], min(r, n - 1)))


def test_packing(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    got = packing.packed_documents(docs).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len((r[1] or "").encode().split())) for r in rows)
    batches = defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r)
    for b in batches.values():
        assert sorted(r.slot for r in b) == list(range(len(b)))
        assert max(r.n_tokens for r in b) <= b[0].bucket_length
        assert len(b) == 1 or len(b) * b[0].bucket_length <= packing.TOKEN_BUDGET
    assert packing.packed_documents(empty).count() == 0
    wide = spark.range(1, 40000, 37).toDF("n").withColumn("g", packing.grid(F.col("n")))
    for r in wide.collect():
        assert r.g == r.n if r.n < 4096 else r.g <= r.n < r.g * (1 + 1 / 2000)


def test_bounds_of_long_texts_are_exact(spark):
    lengths = [n for n in (8192, 8193, 8194, 8195, 70_001, 70_002, 200_000, 200_001) for _ in range(3)]
    given = durable(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long"))
    got = packing.pack(given, "n", ["doc_id"], buckets=8).collect()
    assert sorted(r.n for r in got) == lengths and all(r.bucket_length == r.n for r in got)


def test_batches_hold_the_tokens(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(1, [i] * rng.choice([0, 1, 5, 9, 30, 31, 32]), "b") for i in range(300)], "doc_id long, ids array<int>, bucket string")
    placed = packing.packed(docs.withColumn("n", F.size("ids")), "n", ["doc_id"], buckets=4, budget=64)
    got = packing.batches(placed, "ids", pad=-1).collect()
    sizes = [[len(x) for x in r.rows] for r in got]
    assert all(len(set(s)) == 1 and (len(s) == 1 or sum(s) <= 64) for s in sizes)
    want = Counter(tuple(r.ids) for r in docs.collect())
    assert Counter(tuple(t for t in x if t != -1) for r in got for x in r.rows) == want


def test_packing_query(spark, monkeypatch):
    """Bounds by trying all of them, and every place taken once."""
    got = packing.op6_packing(spark, SF).collect()
    docs = {d.doc_id: len((d.text or "").encode().split()) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in got} == docs
    bounds = sorted({r.bucket_length for r in got})
    lengths = Counter(docs.values())
    cost = {0: 0}  # least padded size of the lengths up to each, bucket by bucket
    order = sorted(lengths)
    for _ in range(packing.BUCKETS):
        step = dict(cost)
        for j in range(1, len(order) + 1):
            step[j] = min(cost[i] + order[j - 1] * sum(lengths[x] for x in order[i:j]) for i in cost if i < j) if any(i < j for i in cost) else step.get(j)
        cost = {k: min(v, cost.get(k, v)) for k, v in step.items()}
    assert sum(min(b for b in bounds if b >= n) * c for n, c in lengths.items()) == cost[len(order)]
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)


# fingerprints -------------------------------------------------------------------


def test_fingerprints(docs, rows, empty):
    got = fingerprint.compare_with_next(docs).withColumn("near", fingerprint.likeness(F.col("sketch"), F.col("edited_sketch"))).collect()
    assert Counter((r["__id"], r.text) for r in got) == Counter((-(2**63) if r[0] is None else r[0], r[1] or "") for r in rows)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text].add((r.sketch.whole, *r.sketch.hashes))
        assert bool(r.sketch.hashes) == bool(r.text.encode().split()) and r.sketch.hashes == sorted(set(r.sketch.hashes))
    assert all(len(s) == 1 for s in by_text.values())
    first = {}
    for r in got:
        first.setdefault(r["__id"], set()).add(r.text)
    ids = sorted(first)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    for r in got:
        h = len(r.text) // 2
        starts = {t[:h] for t in first[after[r["__id"]]]}
        assert r.edited in {r.text[: len(r.text) - h] + s for s in starts}
    assert fingerprint.compare_with_next(empty).count() == 0


def test_sketch_estimates_containment(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:1500])), (3, " ".join(words[:1000] + [f"z{i}" for i in range(1000)])), (4, "")], "i int, t string")
    s = {r.i: r.s for r in fingerprint.with_sketch(df, "t", "s").collect()}
    pair = spark.createDataFrame([(s[a], s[b]) for a, b in ((1, 1), (1, 2), (1, 3), (1, 4), (4, 4))], "a struct<whole:boolean,hashes:array<long>>, b struct<whole:boolean,hashes:array<long>>")
    got = [r.x for r in pair.select(fingerprint.likeness(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == got[1] == 1 and abs(got[2] - 0.5) < 0.12 and got[3:] == [0, 1]


def test_merged_sketch_is_that_of_the_union(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    sizes = [(5, 40), (5, 5), (7, 6), (0, 5), (3, 4), (40, 60), (6, 200), (68, 0), (68, 5), (68, 68), (69, 5), (300, 400)]
    pairs = [([word() for _ in range(n)], [word() for _ in range(m)]) for n, m in sizes * 8]
    pairs += [(a, a[: len(a) // 2]) for a, _ in pairs] + [(a, a) for a, _ in pairs]
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    x = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "sa"), "b", "sb").withColumn("ab", fingerprint.merged(F.col("sa"), F.col("sb")))
    x = x.withColumn("near", fingerprint.likeness(F.col("sa"), F.col("sb"))).withColumn("back", fingerprint.likeness(F.col("sb"), F.col("sa")))
    # all hashes of a text: its sketch when every hash is kept
    x = fingerprint.with_sketch(fingerprint.with_sketch(x, "a", "ha", fraction=0.4999), "b", "hb", fraction=0.4999)
    limit = -(2**63) + 2**62
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))} if t else set()
    for r in x.collect():
        a, b = map(shingles, pairs[r.i])
        low = sorted({h for h in [*r.ha.hashes, *r.hb.hashes] if h < limit})
        assert r.ab.whole == (len(a | b) <= fingerprint.WHOLE)
        assert len(r.ab.hashes) == len(a | b) if r.ab.whole else r.ab.hashes == low
        assert {h for h in r.ab.hashes if h < limit} == set(low) and r.ab.hashes == sorted(r.ab.hashes)
        assert r.near == r.back and 0 <= r.near <= 1
        if r.sa.whole and r.sb.whole:  # exact, also where no hash is below the threshold
            least = min(len(a), len(b))
            assert r.near == (1 if a == b else len(a & b) / least if least else 0)


def test_fingerprint_query(spark):
    """Sketches, edits and likenesses of the query against sets of shingle hashes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [d.text or "" for d in docs]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
    words = {t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w] for t in {*texts, *edited}}
    hash_ = lambda b, seed=42: (xxhash.xxh64_intdigest(b, seed) + 2**63) % 2**64 - 2**63

    def sketch(t):
        h = [hash_(w.encode()) for w in words[t]]
        def chained(part):  # as Spark's function of several columns: each value's hash is the next one's seed
            seed = 42
            for x in part:
                seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed)
            return (seed + 2**63) % 2**64 - 2**63
        all_ = {chained(h[i : i + 5]) for i in range(len(h) - 4)} if len(h) >= 5 else {hash_many(words[t])} if h else set()
        low = {x for x in all_ if x < -(2**63) + 2**62}
        return all_, low if len(all_) > 64 else all_

    def hash_many(ws):  # an array of hashes is hashed the same way
        seed = 42
        for w in ws:
            seed = xxhash.xxh64_intdigest(hash_(w.encode()).to_bytes(8, "little", signed=True), seed)
        return (seed + 2**63) % 2**64 - 2**63

    def shown(s):
        return ("=" if s[0] and len(s[0]) <= 64 else "") + "".join(f"{x % 2**64:016X}" for x in sorted(s[1]))

    def near(a, b):
        if a == b:
            return 1.0
        p, q = (a[0], b[0]) if max(len(a[0]), len(b[0])) <= 64 else ({x for x in s[0] if x < -(2**63) + 2**62} for s in (a, b))
        return len(p & q) / min(len(p), len(q)) if p and q else 0.0

    of = {t: sketch(t) for t in words}
    got = {r.doc_id: r for r in fingerprint.op7_fingerprint(spark, SF).collect()}
    for d, t, e, n in zip(docs, texts, edited, texts[1:] + texts[:1], strict=True):
        assert tuple(got[d.doc_id]) == (d.doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), shown(of[t]), shown(of[e]), near(of[t], of[e]), near(of[t], of[n]))


def test_next_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 40)
    ids = sorted(random.Random(3).sample(range(-(10**12), 10**12), 1000))
    got = {r.i: r.next_id for r in fingerprint.next_ids(spark.createDataFrame([(i,) for i in ids], "i long").repartition(5), "i").collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_fingerprint_plan_has_no_python(spark):
    plan = fingerprint.op7_fingerprint(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# BPE ----------------------------------------------------------------------------


def test_bpe(spark, docs, rows, empty, monkeypatch):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 5_000)
    ranks = bpe.load_ranks(tokenizers.path(bpe.FILE))
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["a\x1cb \x1d c", "  x  y z　 ", "\r\n\t\v\f x", "don't we'LL I'm", "naïve 日本語 🤗🏽 é ½ ² ٣", "<|endoftext|> ==== \n\n\n   a", "\u0085x y", "aAbB" * 200, "z" * 700]
    given = [(r[0], r[1]) for r in rows] + [(10_000 + i, t) for i, t in enumerate(odd)]
    got = bpe.tokenize(spark.createDataFrame(given, "doc_id long, text string").repartition(2), ranks, tokenizers.PATTERN, keep_ids=True).collect()
    want = []
    for i, t in given:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), tuple(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), (t or "").encode()))
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256, bytes(r.decoded)) for r in got) == Counter(want)
    assert bpe.tokenize(empty, ranks, tokenizers.PATTERN).count() == 0


def test_bpe_long_word(spark, monkeypatch):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.load_ranks(tokenizers.path(bpe.FILE))
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("etaoinsh", 3000), ("ab", 1000), ("x", 2500), ("éa日", 400), ("=", 900))]
    got = bpe.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks, tokenizers.PATTERN, keep_ids=True).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_bpe_query(spark):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(tokenizers.path(bpe.FILE)), special_tokens={})
    got = {r.doc_id: r for r in bpe.op9_bpe(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = enc.encode_ordinary(d.text or "")
        assert tuple(got[d.doc_id]) == (d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


# quality ------------------------------------------------------------------------


def test_quality_held_out():
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    ids = sorted(labels)
    random.Random(4).shuffle(ids)
    test, train = ids[:1000], ids[1000:3500]
    y = lambda of, k: np.array([labels[i][k] for i in of], float)
    m = quality.Model([texts[i] for i in train], y(train, "quality"), y(train, "toxic"))
    good, toxic = m.logits([texts[i] for i in test], {})
    assert ((good > 0) == y(test, "quality")).mean() > 0.99
    hit, bad = (toxic > 0), y(test, "toxic") > 0
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.01 * (~bad).sum()


def test_quality_columns(spark, docs, rows, empty):
    given = Counter(tuple(r) for r in docs.collect())
    labels = spark.createDataFrame([(i, int(i % 4 < 2), int(i % 6 == 1)) for i in range(1, 200, 2)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
    assert got.columns == [*docs.columns, "p_good", "p_toxic", "keep"]
    out = got.collect()
    assert Counter(tuple(r)[: len(docs.columns)] for r in out) == given
    assert all(not r.keep for r in out if not (r.text or "").strip()) and all(0 <= r.p_good <= 1 for r in out)
    none = labels.limit(0)
    assert quality.classify_documents(docs, none).count() == len(rows)
    assert quality.classify_documents(empty, labels).count() == 0


def test_quality_any_column_names(spark):
    odd = "doc_id long, text string, `__good` string, `__host` string, c0 string, source string, lang string, p_good string"
    docs = durable(spark.createDataFrame([(i, f"word{i} and more", "g", "h", "c", "s", "l", "p") for i in range(5)], odd))
    labels = durable(spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"))
    got = quality.classify_documents(docs, labels)
    assert got.columns == ["doc_id", "text", "__good", "__host", "c0", "source", "lang", "p_good", "p_toxic", "keep"]
    assert {(r["__good"], r["__host"], r.c0) for r in got.collect()} == {("g", "h", "c")}


def test_quality_query(spark):
    """Posteriors of the query from the model's log-odds and shrinkage written out."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model, rows = quality.fit(docs, labels), docs.collect()
    logit = dict(zip(("good", "toxic"), model.logits([r.text or "" for r in rows], {}), strict=True))
    host = [r.source for r in rows]
    path = ["/".join(x for x in (r.source, r.lang) if x is not None) for r in rows]
    got = {r.doc_id: r for r in quality.op8_quality(spark, SF).collect()}
    want = {}
    for h, z in logit.items():
        p = 1 / (1 + np.exp(-z))
        mean = p.mean()
        sums = lambda keys: {k: (sum(1 for x in keys if x == k), float(p[[x == k for x in keys]].sum())) for k in set(keys)}  # noqa: B023,E731
        by_host, by_path = sums(host), sums(list(zip(host, path, strict=True)))
        n, n2 = len(p), lambda d: float(sum(c * c for c, _ in d.values()))
        kh = quality._strength(n, n2(by_host), sum(c * (s / c - mean) ** 2 for c, s in by_host.values()), len(by_host), mean)
        kp = quality._strength(n, n2(by_path), sum(c * (s / c - by_host[k[0]][1] / by_host[k[0]][0]) ** 2 for k, (c, s) in by_path.items()), len(by_path) - len(by_host) + 1, mean)
        for r, z1, a, b in zip(rows, z, host, path, strict=True):
            at_host = (by_host[a][1] + kh * mean) / (by_host[a][0] + kh)
            c, s = by_path[a, b]
            site = min(max((s + kp * at_host) / (c + kp), 1e-6), 1 - 1e-6)
            want.setdefault(r.doc_id, {})[h] = 1 / (1 + np.exp(-(z1 + np.log(site / (1 - site)) - np.log(mean / (1 - mean)))))
    for r in rows:
        x, y = got[r.doc_id], want[r.doc_id]
        assert abs(x.p_good - y["good"]) < 1e-6 and abs(x.p_toxic - y["toxic"]) < 1e-6
        assert x.keep == (x.p_good >= 0.5 and x.p_toxic < 0.5)


def test_quality_sample_is_of_documents(spark, monkeypatch):
    """Labels of no document take no place in the sample, and long texts are in it."""
    monkeypatch.setattr(quality, "Model", lambda texts, good, toxic: (texts, good.tolist(), toxic.tolist()))
    texts = {i: f"text {i} " * (4000 if i % 4 == 0 else 3) for i in range(20)}
    docs = durable(spark.createDataFrame([*texts.items(), (3, None), (None, "x")], "doc_id long, text string"))
    labels = durable(spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(3000)], "doc_id long, quality int, toxic int"))
    assert quality.fit(docs, labels, limit=20) == ([texts[i] for i in range(20)], [float(i % 2) for i in range(20)], [float(i % 5 == 0) for i in range(20)])
    assert len(quality.fit(docs, labels, limit=7)[0]) == 7
    monkeypatch.setattr(quality, "MAX_FIT_CHARS", 100_000)
    got = quality.fit(docs, labels, limit=20)[0]
    assert got and sum(map(len, got)) <= 100_000
    assert quality.fit(docs, labels.where("doc_id >= 20"), limit=20) == ([], [], [])


def test_sites_are_shrunk(spark):
    rng = random.Random(5)
    rows = []
    for host, n, share in (("big", 4000, 0.3), ("fair", 4000, 0.9), ("tiny", 2, 0.0), (None, 1000, 0.6)):
        rows += [(host, f"{host}/{i % 2}", 6.0 if rng.random() < share else -6.0, -6.0) for i in range(n)]
    sites, mean, n = quality.site_posteriors(spark.createDataFrame(rows, "__host string, __path string, __good double, __toxic double"))
    got = {(r["__host"], r["__path"]): r["__site_good"] for r in sites.collect()}
    assert n == 8 and abs(got["big", "big/0"] - 0.3) < 0.05 and abs(got["fair", "fair/1"] - 0.9) < 0.05
    assert got["tiny", "tiny/0"] > 0.1 and abs(got[None, "None/0"] - 0.6) < 0.06


# pipeline -----------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, docs
    for _, stage in p.STAGES[:-1]:
        folder = new_folder(spark, "t")
        stage(spark, kept, SF).write.parquet(folder)
        kept = spark.read.parquet(folder)
        assert kept.columns == names
    ids = {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in p.run(spark, SF).collect()} == ids
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not [i for i in ids if i in labels and not labels[i].quality]
    assert all(r.n_chars == len(r.text) for r in kept.collect())


def test_pipeline_odd_rows(spark):
    import corpus_pipeline as p

    long, near = " ".join(f"word{i}" for i in range(3000)), " ".join(f"other{i}" for i in range(200))
    texts = [None, "", long, long, near, near + " end", f"{' '.join(f'x{i}' for i in range(30))} {' '.join(f'word{i}' for i in range(40))}", None]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `was_null` string, `c1` string, kept string, `__g` string"
    rows = [(None if i == 7 else i, t, None if i % 2 else "en", None, len(t or ""), "a", "b", "c", "d") for i, t in enumerate(texts)] + [(2, long, "en", None, len(long), "a", "b", "c", "d")]
    docs = durable(spark.createDataFrame(rows, schema))
    kept = durable(p.near_duplicates(spark, docs, SF))
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == {(None, None), (2, long), (4, near), (6, texts[6])}
    cut = durable(p.repeated_passages(spark, kept, SF))
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and got[None].text is None and got[2].text == long and got[6].text.split() == texts[6].split()[:30]
    assert got[6].n_chars == len(got[6].text) and (got[2].was_null, got[2].c1, got[2].kept, got[2]["__g"]) == ("a", "b", "c", "d")
    assert p.packing(spark, cut, SF).count() == 4
    none = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, SF).count() == 0
    assert p.quality(spark, docs, SF).columns == docs.columns
