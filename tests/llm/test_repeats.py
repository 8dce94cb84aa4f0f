"""op1 and op10 against definitions written out in full."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from basalt.llm import groups
from basalt.llm import substring_dedup as words
from basalt.llm import suffix_dedup as suffix

NULL = -(2**63)


def keyed(rows):
    """(id, text bytes) in the documented order: by id, then by Spark's hash of the text."""
    order = lambda x: (x[0], (xxhash.xxh64_intdigest(x[1], 42) + 2**63) % 2**64)
    return sorted(((NULL if r[0] is None else r[0], (r[1] or "").encode()) for r in rows), key=order)


def brute_bytes(rows, window):
    seen, out = set(), []
    for i, b in keyed(rows):
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            s = b[k : k + window]
            if s in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((None if i == NULL else i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return Counter(out)


def brute_words(rows, window):
    parts = [(i, re.findall(rb"[^\x20\x09-\x0D]+", b)) for i, b in keyed(rows)]
    first = {}
    for i, w in parts:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(i, first.get(s, i))
    out = []
    for i, w in parts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((None if i == NULL else i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize("hot, radix", [(20_000, 64), (2, 64), (20_000, 3)])
def test_bytes(docs, rows, small_groups, monkeypatch, hot, radix):
    monkeypatch.setattr(suffix, "HOT_SEGMENTS", hot)  # 2: most buckets are dealt by whole windows
    monkeypatch.setattr(suffix, "COMPARE_BYTES", 20_000)
    monkeypatch.setattr(suffix, "PARTITION_BYTES", 20_000)
    monkeypatch.setattr(groups, "RADIX", radix)
    monkeypatch.setattr(suffix, "INDEX_BYTES", 3_000)
    monkeypatch.setattr(suffix, "STEP", 5_000)
    got = suffix.suffix_dedup(docs, keep=["lang", "kept"]).toDF("doc_id", "lang", "extra", "n", "gone", "spans", "kept").collect()
    assert Counter((r.doc_id, r.n, r.gone, r.spans, bytes(r.kept)) for r in got) == brute_bytes(rows, 100)


@pytest.mark.parametrize("radix", [64, 3])
def test_words(docs, rows, small_groups, monkeypatch, radix):
    monkeypatch.setattr(words, "PARTITION_BYTES", 9_000)
    monkeypatch.setattr(groups, "RADIX", radix)
    monkeypatch.setattr(words, "STEP", 5_000)
    got = words.substring_dedup(docs, keep=["lang", "__g"]).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, b" ".join(r.kept.encode().split())) for r in got) == brute_words(rows, 13)
    whole = {(r[0], (r[1] or "")) for r in rows}
    assert all((r.doc_id, r.kept) in whole for r in got if not r.n_removed)


def test_places_of_long_words(spark):
    long = "x" * 65_535
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"a {long} b {rest}"), (2, f"b {long} a {rest}"), (3, f"a{long}b {rest}"), (4, f"b{long}a {rest}"), (5, f"b{long}a {rest}")]
    got = {r.doc_id: r.n_removed for r in words.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}


def test_packages_grow_with_the_text(docs):
    assert groups.levels(64 << 20, 1 << 20) == 1 and groups.levels(65 << 20, 1 << 20) == 2 and groups.levels(2**40, 16 << 20) == 3


def test_empty_tables(empty):
    assert suffix.suffix_dedup(empty).count() == 0
    assert words.substring_dedup(empty, keep=["lang"]).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_interval_expansion(seed):
    rng = random.Random(seed)
    bound, letters = rng.choice([4, 7, 33, 100]), rng.choice([1, 2, 4, 26])
    segs = []
    for _ in range(rng.randint(1, 12)):
        s = bytes(97 + rng.randrange(letters) for _ in range(rng.randint(bound, bound + 60)))
        if segs and rng.random() < 0.5:
            s = s[:10] + rng.choice(segs) + s[10:]
        segs.append(s)
    ids, starts = np.array([rng.randint(0, 5) for _ in segs]), np.array([rng.randint(0, 50) for _ in segs])
    got = suffix.repeated_windows(segs, ids, np.arange(len(segs)), starts, bound)
    first = {}
    place = lambda i, k: (ids[i], i, starts[i] + k)
    windows = [(s[k : k + bound], place(i, k)) for i, s in enumerate(segs) for k in range(len(s) - bound + 1)]
    for w, p in windows:
        first[w] = min(p, first.get(w, p))
    assert [f for s in got for f in s.tolist()] == [first[w] < p for w, p in windows]


def test_common_prefixes():
    text = np.array([2, 1, 2, 1, 2, 3, 0])
    order = suffix.bounded_suffix_order(text, 10)
    suffixes = [tuple(text[i:].tolist()) for i in order]
    assert suffixes == sorted(suffixes)
    lcp = suffix.common_prefixes(text, order, 2)
    expected = [sum(1 for _ in iter(lambda a=a, b=b, n=[0]: n.__setitem__(0, n[0] + 1) or (n[0] <= min(len(a), len(b)) and a[: n[0]] == b[: n[0]]), False)) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    assert [x if x >= 0 else 2 for x in lcp[1:].tolist()] == [min(e, 2) for e in expected]


def test_queries_hash_what_stays(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    a = {r.doc_id: r for r in suffix.op1_suffix_dedup(spark, sf).collect()}
    for (i, n, gone, spans, kept), _ in brute_bytes([(d.doc_id, d.text) for d in docs], 100).items():
        assert tuple(a[i]) == (i, n, gone, spans, hashlib.sha256(kept).hexdigest())
    b = {r.doc_id: r for r in words.op10_substring_dedup(spark, sf).collect()}
    for (i, n, gone, kept), _ in brute_words([(d.doc_id, d.text) for d in docs], 13).items():
        assert tuple(b[i]) == (i, n, gone, hashlib.sha256(kept).hexdigest())
