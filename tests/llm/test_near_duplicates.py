import math
import random
from collections import Counter

import pytest

from basalt.llm import near_duplicates as nd

NULL = -(2**63)


def shingles(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, count_classes=False):
    docs = [(NULL if r[0] is None else r[0], r[1] or "") for r in rows]
    sets = [shingles(t) for _, t in docs]
    n = len(docs)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if docs[i][1] == docs[j][1] or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    if count_classes:
        return len({find(i) for i in range(n)})
    least = {}
    for i in range(n):
        least[find(i)] = min(docs[i][0], least.get(find(i), docs[i][0]))
    copies = Counter(t for _, t in docs)
    shown = lambda x: None if x == NULL else x
    return Counter((shown(docs[i][0]), shown(least[find(i)]), links[i], copies[docs[i][1]]) for i in range(n))


@pytest.mark.parametrize("block, crowd", [(1024, 256), (6, 256), (1024, 2)])
def test_classes_and_links(docs, rows, small_groups, monkeypatch, block, crowd):
    monkeypatch.setattr(nd, "PARTITION_BYTES", 10_000)
    monkeypatch.setattr(nd.Join.__init__, "__defaults__", ((), block, crowd))
    got = Counter(tuple(r) for r in nd.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_one_per_class(docs, rows, small_groups):
    got = nd.one_per_class(docs)
    assert got.columns == docs.columns
    classes = brute(rows)
    assert got.count() == brute(rows, count_classes=True)  # some ids are shared by texts of two classes
    assert {r.doc_id for r in got.collect()} == {c for _, c, _, _ in classes}
    given = Counter(tuple(r) for r in docs.collect())
    assert not Counter(tuple(r) for r in got.collect()) - given


def test_empty(empty):
    assert nd.near_duplicates(empty).count() == 0 and nd.one_per_class(empty).count() == 0


def met(lengths, threshold=0.8):
    return 1 - math.prod(1 - threshold**x for x in lengths)


def test_prefixes_are_shortened_until_recall():
    usual = nd.prefix_lengths(0.8, {})
    assert nd.TARGET <= met(usual) and max(usual) - min(usual) <= 1
    longer = [*usual]
    longer[usual.index(min(usual))] += 1
    assert met(longer) < nd.TARGET  # no step more than needed
    assert sum(nd.prefix_lengths(0.99, {})) > sum(usual) > sum(nd.prefix_lengths(0.5, {}))


def test_crowded_trees_keep_long_prefixes():
    crowded = {t: [5000, 5000, 5000] for t in (2, 3, 9)}
    got = nd.prefix_lengths(0.8, crowded)
    assert met(got) >= nd.TARGET
    assert all(got[t] == nd.DEEPEST for t in crowded) and min(got) == nd.shortest(0.8)
    everywhere = nd.prefix_lengths(0.8, {t: [9000, 5000, 3000] for t in range(nd.TREES)})
    assert met(everywhere) >= nd.TARGET
    mixed = nd.prefix_lengths(0.8, {t: [9000, 300 if t % 2 else 90_000, 10] for t in range(nd.TREES)})
    assert met(mixed) >= nd.TARGET and sum(mixed[1::2]) < sum(mixed[::2])


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_forest_buckets(spark, crowd):
    """Against the rule: the highest node of a path to which any text shortened."""
    rng, least, bits = random.Random(3), nd.shortest(0.8), nd.value_bits(nd.shortest(0.8))
    paths = [(v, t, [rng.randrange(4) for _ in range(1 + nd.DEEPEST - least)]) for v in range(90) for t in range(nd.TREES)]
    sizes = Counter((t, *p[:n]) for _, t, p in paths for n in range(1, len(p) + 1))
    lengths = {}
    for v in range(90):
        mine = [(t, p) for w, t, p in paths if w == v]
        nodes = {t: [sizes[(t, *p[:n])] for n in range(1, len(p))] for t, p in mine if sizes[(t, p[0])] > crowd}
        lengths[v] = nd.prefix_lengths(0.8, nodes, crowd)
    reached = {(t, *p[: 1 + lengths[v][t] - least]) for v, t, p in paths}
    bucket = {(v, t): next((t, *p[:n]) for n in range(1, len(p) + 1) if (t, *p[:n]) in reached) for v, t, p in paths}
    members = {}
    for (v, _), node in bucket.items():
        members.setdefault(node, []).append(v)
    want = {(v, t, min(members[node])) for (v, t), node in bucket.items() if len(members[node]) > 1}
    rows = [(b"%04d" % v, v, t, p[0], sum(x << bits * (len(p) - 2 - k) for k, x in enumerate(p[1:]))) for v, t, p in paths]
    got = nd.forest(spark.createDataFrame(rows, "v binary, key long, tree int, head long, tail long"), 0.8, crowd).collect()
    assert len(got) == len(want) and {(int(r.v), r.tree, r.leader) for r in got} == want


def test_components(spark):
    edges = [(f"{a:03}", f"{b:03}") for a, b in [(i, i + 1) for i in range(40) if i % 10 != 9] + [(50, 60), (60, 70), (55, 70), (7, 7)]]
    got = {r.v: r.root for r in nd.connected(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {f"{i:03}": f"{i - i % 10:03}" for i in range(40) if i % 10} | {f"{i:03}": "050" for i in (55, 60, 70)}
