"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

Documents are sets of five-word shingles; a link joins two different texts whose
sets have a Jaccard similarity of ``THRESHOLD`` or more.

* Equal texts are collapsed to the one with the least id, with a weight.
* Each of ``TREES`` trees is a prefix trie of signatures of ``DEEPEST`` MinHash
  values. A text of which only its own path is left finds nobody there; of the
  others each starts with its whole signature in every tree and shortens these
  prefixes one value at a time, until the share of pairs at the threshold that
  it then meets, ``1 - prod(1 - s^length)``, reaches ``TARGET``
  (:func:`prefix_lengths`). Nodes of at most ``CROWD`` texts come first, the
  longest prefix first; a crowded node is shortened to only if the others
  leave the text below the target. So texts in crowded parts of some tries
  keep long prefixes there and shorten them elsewhere.
* A text's bucket in a tree is the highest node on its path to which any text
  has shortened: two texts meet if either one's prefix reaches the other.
  Buckets of one tree never overlap; they are found from the shortest length
  down, each level once (:func:`forest`). Level and node sizes are aggregated
  before they are joined, so a node may hold any share of the texts.
* A bucket is known by its least member, so the buckets that a group of near
  copies forms in many trees meet in one place, and each member's shingles
  travel there once. A bucket of more than ``BLOCK`` members is compared block
  against block, in tasks of their own.
* Every candidate pair is verified exactly, in the first tree in which it
  meets. Pairs never leave a task: what does are, for each text, its number of
  links and the least text it is connected to.
* Classes are the connected components of these stars, found by alternating
  large-star and small-star rounds over written tables.

Defined cases: a null text is empty; a text of fewer than five words is one
shingle of all its words; texts without words have no links except to equal
texts; an empty table gives no rows; a null id sorts first; rows that share an
id stay apart unless their texts are equal, and come in the order of a hash of
their text; of equal rows one stays where one document is kept; texts of any
length are taken whole; further columns pass through :func:`one_per_class` by
place, so that no name can clash.
"""

from __future__ import annotations

import math
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from . import groups as g_
from .groups import ASK, G, ID, Texts
from .hashing import Words, mix, window_hashes
from .storage import drop, durable, written

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
#: Length of a signature, the longest prefix.
DEEPEST = 6
#: Share of the pairs at exactly the threshold that a text is to meet.
TARGET = 0.9997
#: A node of more texts is crowded; texts shorten to it after all others.
CROWD = 256
#: Members of a bucket that are compared in one task at most.
BLOCK = 1024
STEP = 1 << 20
PARTITION_BYTES = 8 << 20
_RNG = np.random.Generator(np.random.PCG64(7))
_FLIP = _RNG.integers(0, 2**63, TREES * DEEPEST, dtype=np.uint64)
_TIMES = _RNG.integers(0, 2**63, TREES * DEEPEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Share of pairs of this similarity that meet under a prefix of this length."""
    return 1 - (1 - similarity**depth) ** trees


def shortest(threshold: float, target: float = TARGET, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """One value less than the length that reaches the target in all trees at
    once: what texts may shorten to, to make up for crowded trees."""
    length = deepest
    while length > 1 and recall(threshold, length, trees) < target:
        length -= 1
    return max(1, length - 1)


def prefix_lengths(threshold: float, nodes: dict[int, list[int]], crowd: int = CROWD, target: float = TARGET) -> list[int]:
    """The prefix length of a text in each tree.

    ``nodes`` gives the trees where the text's node at the shortest length is
    crowded, with the sizes of its nodes from that length on, down to the
    longest but one. Sizes are told apart by powers of two times ``crowd``
    alone, so that a few partners more or less do not choose the tree."""
    least = shortest(threshold, target)
    length = [DEEPEST] * TREES
    miss = math.prod(1 - threshold**x for x in length)

    def cost(tree: int) -> tuple[int, int, int]:
        size = nodes[tree][length[tree] - 1 - least] if tree in nodes else 0
        return (max(size - 1, 0) // crowd).bit_length(), -length[tree], tree

    while 1 - miss < target:
        left = [t for t in range(TREES) if length[t] > least]
        if not left:
            break
        tree = min(left, key=cost)
        miss *= (1 - threshold ** (length[tree] - 1)) / (1 - threshold ** length[tree])
        length[tree] -= 1
    return length


def shingle_sets(texts: Texts, size: int, only: np.ndarray | None = None):
    """(document, sorted distinct shingle hashes) for documents with words."""
    for i, j in texts.spans(STEP):
        if only is not None and not only[i:j].any():
            continue
        lo, hi = texts.offsets[i], texts.offsets[j]
        w = Words(texts.data[lo:hi], texts.offsets[i : j + 1] - lo)
        rolling = window_hashes(w.hash, np.flatnonzero(w.windows(size)), size)
        n = np.diff(w.first)
        ends = np.cumsum(np.maximum(n - size + 1, 0))
        for k in range(j - i):
            if not n[k] or only is not None and not only[i + k]:
                continue
            if n[k] < size:
                yield i + k, window_hashes(w.hash, w.first[k : k + 1], int(n[k]))
            else:
                yield i + k, np.unique(rolling[ends[k] - (n[k] - size + 1) : ends[k]])


def vertex(doc_id: int, text: bytes) -> bytes:
    """A text's key, in the order of ids: the id, then a 128-bit hash."""
    return (doc_id + 2**63).to_bytes(8, "big") + xxh3_128_digest(text)


def vertex_id(v: Column) -> Column:
    """The id in a key; null where it was null."""
    n = F.conv(F.hex(F.substring(v, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")
    n = n.cast("long")
    return F.when(n != g_.NULL_ID, n)


def value_bits(least: int) -> int:
    """Bits that each value after the first ``least`` has in a signature."""
    return 60 // max(1, DEEPEST - least)


def _sign(size: int, least: int):
    bits = np.uint64(value_bits(least))

    def sign(table: pa.Table) -> pa.Table:
        t = Texts(g_.ordered(table))
        heads: list[list[int]] = [[] for _ in range(len(t))]
        tails: list[list[int]] = [[] for _ in range(len(t))]
        batch: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if not batch:
                return
            flat = np.concatenate([s for _, s in batch])
            starts = np.cumsum([0, *[len(s) for _, s in batch[:-1]]])
            head = np.empty((len(batch), TREES), np.uint64)
            tail = np.zeros((len(batch), TREES), np.uint64)
            for tree in range(TREES):
                key = np.full(len(batch), tree + 1, np.uint64)
                for k in range(DEEPEST):
                    at = tree * DEEPEST + k
                    least_hash = np.minimum.reduceat((flat ^ _FLIP[at]) * _TIMES[at], starts)
                    if k < least:
                        key = mix(key * _TIMES[0] + least_hash)
                    else:
                        tail[:, tree] = tail[:, tree] << bits | mix(least_hash * _TIMES[0]) >> np.uint64(64) - bits
                head[:, tree] = key
            for (doc, _), x, y in zip(batch, head.view(np.int64).tolist(), tail.view(np.int64).tolist(), strict=True):
                heads[doc], tails[doc] = x, y
            batch.clear()

        held = 0
        for doc, s in shingle_sets(t, size):
            batch.append((doc, s))
            held += len(s)
            if held > 100_000:
                flush()
                held = 0
        flush()
        keys = [vertex(int(i), t.bytes_of(k)) for k, i in enumerate(t.ids)]
        g = table.column(G)[0].as_py()
        of_long = pa.list_(pa.int64())
        return pa.table({G: pa.array([g] * len(t), pa.int32()), "v": pa.array(keys, pa.binary()), "heads": pa.array(heads, of_long), "tails": pa.array(tails, of_long)})

    return sign


def _lengths(threshold: float, crowd: int):
    def lengths(batches):
        for batch in batches:
            out = []
            for nodes in batch.column("nodes").to_pylist():
                out.append(prefix_lengths(threshold, {n["tree"]: n["sizes"] for n in nodes}, crowd))
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(out, pa.list_(pa.int32()))], names=["v", "lengths"])

    return lengths


def forest(rows: DataFrame, threshold: float, crowd: int = CROWD) -> DataFrame:
    """``rows`` (``v``, ``key``, ``tree``, ``head``, ``tail`` and more, a row per
    text and tree) that share a bucket, with its ``leader``, the least key in it.

    Everything that is joined is written first, so that a node of very many
    texts lies in plain exchanges, which adaptive execution can split."""
    least = shortest(threshold)
    bits = value_bits(least)

    def path(length: int) -> list:
        return ["tree", "head", F.shiftright("tail", bits * (DEEPEST - length)).alias("node")] if length > least else ["tree", "head"]

    def sized(frame: DataFrame, length: int, name: str, *more: Column) -> DataFrame:
        return durable(frame.groupBy(*path(length)).agg(F.count(F.lit(1)).alias(name), *more))

    def beside(frame: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
        if length == least:
            return frame.join(nodes, ["tree", "head"])
        return frame.withColumn("node", path(length)[2]).join(nodes, ["tree", "head", "node"]).drop("node")

    # alone under the shortest prefix is alone under every longer one
    met = durable(beside(rows, durable(sized(rows, least, "size").where("size > 1")), least))
    full = met.where(F.col("size") > crowd).select("v", "tree", "head", "tail", F.array("size").alias("sizes"))
    for length in range(least + 1, DEEPEST):
        full = durable(beside(full, sized(full, length, "n"), length).withColumn("sizes", F.concat("sizes", F.array("n"))).drop("n"))
    chosen = full.groupBy("v").agg(F.collect_list(F.struct("tree", "sizes")).alias("nodes")).mapInArrow(_lengths(threshold, crowd), "v binary, lengths array<int>")
    usual = F.array(*[F.lit(n) for n in prefix_lengths(threshold, {}, crowd)])
    left = durable(met.drop("size").join(durable(chosen), "v", "left").withColumn("length", F.get(F.coalesce("lengths", usual), F.col("tree"))).drop("lengths"))
    out = None
    for length in range(least, DEEPEST + 1):
        nodes = sized(left, length, "n", F.min("length").alias("reach"), F.min("key").alias("leader")).where("n > 1")
        at = durable(beside(left, nodes, length))
        found = at.where(F.col("reach") <= length).drop("n", "reach", "length", "head", "tail", "key")
        out = found if out is None else out.unionByName(found)
        left = at.where(F.col("reach") > length).drop("n", "reach", "leader")
    return out


SHIP = f"{G} int, v binary, copies long, held array<struct<tree:int,leader:long,members:long>>"


def _ship(size: int, partitions: int, block: int):
    def ship(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not reply.num_rows or not table.num_rows:
            return g_.asks([])
        t = Texts(g_.ordered(table))
        wanted = {r["v"]: r for r in reply.to_pylist()}
        ids = np.unique(np.array([int.from_bytes(v[:8], "big") - 2**63 for v in wanted], np.int64))
        only, rows = np.isin(t.ids, ids), {}
        for k in np.flatnonzero(only):
            r = wanted.pop(vertex(int(t.ids[k]), t.bytes_of(k)), None)
            only[k] = r is not None
            if r is not None:
                rows[int(k)] = r
        parts: dict[int, dict] = {}
        for k, s in shingle_sets(t, size, only):
            r = rows[k]
            leaders = np.zeros(TREES, np.int64)
            for h in r["held"]:
                leaders[h["tree"]] = h["leader"]
            to: dict[int, list] = {}
            for leader, members in {(h["leader"], h["members"]) for h in r["held"]}:
                blocks = -(-members // block)
                mine = zlib.crc32(r["v"]) % blocks
                for other in range(blocks):
                    a, b = min(mine, other), max(mine, other)
                    p = zlib.crc32(f"{leader},{a},{b}".encode()) % partitions
                    to.setdefault(p, []).append((leader, a, b, mine))
            for p, units in to.items():
                x = parts.setdefault(p, {"v": [], "copies": [], "leaders": [], "sets": [], "units": []})
                x["units"] += [(len(x["v"]), *u) for u in units]
                x["v"].append(r["v"])
                x["copies"].append(r["copies"])
                x["leaders"].append(leaders)
                x["sets"].append(s)
        g = table.column(G)[0].as_py()
        return g_.asks([(p, g, len(x["v"]), pickle.dumps(x, 5)) for p, x in parts.items()])

    return ship


def _alike(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, as a symmetric matrix."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # what one set alone holds adds to no intersection
    new = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], new[col[keep]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 4096 if n < 256 else 1024
    for c in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, (c, c + width))
        m = np.zeros((n, width), np.float32)
        m[row[a:b], col[a:b] - c] = 1
        common += m @ m.T
    return common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6


def _components(n: int, links: np.ndarray) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(links, 1)), strict=True):
        x, y = find(int(a)), find(int(b))
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def _verify(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        v, copies, leaders, sets, units = [], [], [], [], {}
        for blob in table.column("__blob"):
            x = pickle.loads(blob.as_buffer())
            base = len(v)
            v += x["v"]
            copies += x["copies"]
            leaders += x["leaders"]
            sets += x["sets"]
            for k, leader, a, b, mine in x["units"]:
                units.setdefault((leader, a, b), []).append((base + k, mine))
        out_v, out_root, out_links = [], [], []
        for (leader, a, b), members in units.items():
            if len(members) < 2:
                continue
            members.sort(key=lambda m: v[m[0]])
            at = [k for k, _ in members]
            block = np.array([m for _, m in members])
            tree = np.array([leaders[k] for k in at])
            n = len(at)
            # the first tree in which a pair meets must be one of this bucket
            met, here = np.zeros((n, n), bool), np.zeros((n, n), bool)
            for k in range(TREES):
                same = (tree[:, None, k] == tree[None, :, k]) & (tree[:, None, k] != 0)
                here |= same & ~met & (tree[:, None, k] == leader)
                met |= same
            if a != b:
                here &= block[:, None] != block[None, :]
            np.fill_diagonal(here, False)
            if not here.any():
                continue
            links = here & _alike([sets[k] for k in at], threshold)
            if not links.any():
                continue
            weight = links @ np.array([copies[k] for k in at], np.int64)
            root = _components(n, links)
            for i in np.flatnonzero(links.any(1)):
                out_v.append(v[at[i]])
                out_root.append(v[at[root[i]]])
                out_links.append(int(weight[i]))
        return pa.table({"v": pa.array(out_v, pa.binary()), "root": pa.array(out_root, pa.binary()), "links": pa.array(out_links, pa.int64())})

    return verify


def connected(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex of ``u, v`` edges: the least vertex connected to it.

    The least neighbours are written before edges are joined with them: both
    sides of each join are then plain exchanges of stored rows, which adaptive
    execution splits where a hub holds many of them. Tables of past rounds are
    removed.
    """
    spark = edges.sparkSession
    now, folder = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low, low_at = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large, large_at = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        least, least_at = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        now, new_folder_ = written(small.where("u != v").distinct())
        for past in (folder, low_at, large_at, least_at):
            drop(spark, past)
        folder = new_folder_
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        mark = new


class Join:
    """The join's tables; texts are dealt into groups once, ``keep`` columns with them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, threshold: float, keep: list[str] = (), block: int = BLOCK, crowd: int = CROWD):
        total = g_.text_bytes(docs, text_col)
        n = g_.group_count(docs, total)
        partitions = max(n, math.ceil(total / PARTITION_BYTES))
        self.by_group = g_.grouped(docs, id_col, text_col, n, keep)
        signed = self.by_group.groupBy(G).applyInArrow(_sign(SHINGLE, shortest(threshold)), f"{G} int, v binary, heads array<long>, tails array<long>")
        self.signed = durable(signed.withColumn("h", F.substring("v", 9, 16)))
        one = self.signed.groupBy("h").agg(F.min(F.struct("v", G, "heads", "tails")).alias("m"), F.count(F.lit(1)).alias("copies"))
        self.reps = durable(one.select("h", "m.v", f"m.{G}", "m.heads", "m.tails", "copies"))
        rows = self.reps.select("v", G, "copies", F.xxhash64("v").alias("key"), "tails", F.posexplode("heads").alias("tree", "head"))
        rows = rows.withColumn("tail", F.get("tails", F.col("tree"))).drop("tails")
        held = durable(forest(rows, threshold, crowd))
        # written, so that the join below reads two plain exchanges and a leader of very many can be split
        members = durable(held.select("v", "leader").distinct().groupBy("leader").agg(F.count(F.lit(1)).alias("members")))
        replies = held.join(members, "leader").groupBy(G, "v", "copies").agg(F.collect_list(F.struct("tree", "leader", "members")).alias("held")).select(G, "v", "copies", "held")
        shipped = self.by_group.groupBy(G).cogroup(replies.groupBy(G)).applyInArrow(_ship(SHINGLE, partitions, block), ASK)
        found = durable(shipped.groupBy("__p").applyInArrow(_verify(threshold), "v binary, root binary, links long"))
        self.links = found.groupBy("v").agg(F.sum("links").alias("links"))
        self.classes = connected(found.select(F.col("v").alias("u"), F.col("root").alias("v")))

    def decisions(self) -> DataFrame:
        """``v`` of every row with ``copies``, ``links`` and ``root``."""
        reps = self.reps.select(F.col("h").alias("__h"), F.col("v").alias("rep"), "copies")
        reps = reps.join(self.links.withColumnRenamed("v", "rep"), "rep", "left").join(self.classes.withColumnRenamed("v", "rep"), "rep", "left")
        reps = reps.select("__h", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
        return self.signed.select(G, "v", "h").join(reps, F.col("h") == F.col("__h")).drop("h", "__h")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: ``class_id`` (the least id of its class), ``n_links``
    (documents with a similar or equal text) and ``n_copies`` (equal texts)."""
    x = Join(docs, id_col, text_col, threshold).decisions()
    return x.select(vertex_id(F.col("v")).alias(id_col), vertex_id(F.col("root")).alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that have a kept near duplicate: of each
    class the row with the least id stays, with all its columns."""
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    id_at, text_at = names[columns.index(id_col)], names[columns.index(text_col)]
    marked = docs.toDF(*names).withColumn("was_null", F.col(text_at).isNull())
    rest = [c for c in marked.columns if c != text_at]
    x = Join(marked, id_at, text_at, threshold, rest)
    stay = x.decisions().where("v = root").select(G, "v").distinct()
    held = [*[f"__k{i}" for i in range(len(rest))], g_.TEXT]

    def keep(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows or not reply.num_rows:
            return table.select(held).slice(0, 0)
        t = g_.ordered(table)
        left = set(reply.column("v").to_pylist())
        mask = []
        for i, text in zip(t.column(ID).to_pylist(), t.column(g_.TEXT).to_pylist(), strict=True):
            v = vertex(i, text)
            mask.append(v in left)
            left.discard(v)
        return t.filter(pa.array(mask, pa.bool_())).select(held)

    schema = T.StructType([*g_.keep_fields(marked, rest), T.StructField(g_.TEXT, T.BinaryType())])
    out = x.by_group.groupBy(G).cogroup(stay.groupBy(G)).applyInArrow(keep, schema).toDF(*rest, text_at)
    text = F.when(~F.col("was_null"), F.col(text_at).cast("string"))
    return out.select(*[(text if n == text_at else F.col(n)).alias(c) for n, c in zip(names, columns, strict=True)])


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
