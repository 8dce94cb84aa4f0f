"""Byte-level BPE encoding and decoding by a fold of ranked merges.

Each distinct word of the corpus is encoded once:

1. Texts are split by the tokenizer's pattern, in chunks of a bounded number of
   characters. A chunk is one row: its distinct words and, for its documents,
   the places of their words among them, packed.
2. Chunks send their distinct words, packed by word hash, to the buckets of the
   vocabulary. However often a chunk holds a word, it is sent once.
3. Spark's higher-order functions encode a bucket's distinct words: the bytes of
   a word are pieces, and a fold merges the leftmost pair of least rank, with
   only the two ranks beside a merge looked up anew, until no pair has a rank.
   The rank table is one literal of the plan: an array of small maps, addressed
   by the crc32 of the piece.
4. Buckets answer each chunk, and the chunk's documents are put together from
   their words' ids. Decoding concatenates the binary pieces of the ids.

Defined cases: null and empty texts have no tokens and decode to no bytes;
special tokens are ordinary text; an empty table gives no rows; rows are
independent of one another, so repeated rows and shared or null ids give a row
each, and there are no ties; other columns are not read, so none can clash. A
text is one chunk at most, whatever its length. A word of n bytes takes up to n
merges; words of over ``LONG`` bytes keep their pieces in blocks, so that a
merge costs some sqrt(n) steps.
"""

from __future__ import annotations

import base64
import copy
import hashlib
import json
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import text_bytes

#: Maps in the rank literal; a lookup compares one key or two.
SLOTS = 65_536
NONE = 2**31 - 1
#: Characters of a chunk's texts, one document at least.
CHUNK_CHARS = 32 << 20
#: Bytes of text for each bucket of the vocabulary.
BUCKET_BYTES = 16 << 20
#: Words that are encoded together; bounds the arrays of a row.
BATCH_WORDS = 1024
#: Bytes from which a word's pieces are kept in blocks.
LONG = 256
FILE = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Table:
    """The rank file as literals: piece (in hex) to rank, and rank to piece."""

    def __init__(self, ranks: dict[bytes, int]):
        slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            h = piece.hex().upper()
            slots[zlib.crc32(h.encode()) % SLOTS][h] = rank
            pieces[rank] = h
        self.slots = F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def bound(self, slots: Column) -> Table:
        """The same with the slots in a variable, so that the plan holds their literal once."""
        other = copy.copy(self)
        other.slots = slots
        return other

    def rank(self, piece: Column) -> Column:
        slot = F.get(self.slots, F.pmod(F.crc32(piece.cast("binary")), F.lit(SLOTS)).cast("int"))
        return F.coalesce(F.try_element_at(slot, piece), F.lit(NONE))

    def piece(self, rank: Column) -> Column:
        return F.get(self.pieces, rank)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, and not copied (as ``transform`` would)."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def _merge(p: Column, r: Column, i: Column, table: Table) -> Column:
    """Pieces and ranks after merging pieces i and i + 1.

    ``r`` has an entry for each piece: the rank of it and the next together."""
    n = F.size(p)
    whole = F.concat(F.get(p, i), F.get(p, i + 1))
    none = F.array().cast("array<int>")

    def joined(w: Column) -> Column:
        left = F.when(i > 0, F.array(table.rank(F.concat(F.get(p, i - 1), w)))).otherwise(none)
        right = F.when(i + 2 < n, table.rank(F.concat(w, F.get(p, i + 2)))).otherwise(NONE)
        return F.struct(
            F.concat(F.slice(p, F.lit(1), i), F.array(w), F.slice(p, i + 3, n)).alias("p"),
            F.concat(F.slice(r, F.lit(1), F.greatest(i - 1, F.lit(0))), left, F.array(right), F.slice(r, i + 3, n)).alias("r"),
        )

    return _let(whole, joined)


def _place(r: Column, m: Column) -> Column:
    return (F.array_position(r, m) - 1).cast("int")


def _ranks(p: Column, table: Table) -> Column:
    last = F.size(p) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i < last, table.rank(F.concat(F.get(p, i), F.get(p, i + 1)))).otherwise(NONE))


def _folded(p: Column, table: Table) -> Column:
    """The pieces that are left when no pair has a rank."""

    def step(acc: Column, _: Column) -> Column:
        done = F.struct(acc["p"].alias("p"), F.array().cast("array<int>").alias("r"))
        merge = lambda m: F.when(m == NONE, done).otherwise(_let(_place(acc["r"], m), lambda i: _merge(acc["p"], acc["r"], i, table)))
        return F.when(F.size(acc["r"]) == 0, acc).otherwise(_let(F.array_min(acc["r"]), merge))

    start = F.struct(p.alias("p"), _ranks(p, table).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), start, step)["p"]


def _folded_in_blocks(p: Column, table: Table) -> Column:
    """The same for many pieces. Blocks of some sqrt(n) pieces know their least
    rank; a merge takes the block that has it with its neighbours (two behind,
    so that the piece after the pair is among them) and deals them anew."""
    n = F.size(p)

    def dealt(x: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(x["p"]) - 1, size), lambda k: F.struct(F.slice(x["p"], k + 1, size).alias("p"), F.slice(x["r"], k + 1, size).alias("r")))

    def least(blocks: Column) -> Column:
        return F.transform(blocks, lambda x: F.array_min(x["r"]))

    def state(blocks: Column) -> Column:
        return F.struct(blocks.alias("b"), least(blocks).alias("m"))

    def step(acc: Column, _: Column) -> Column:
        b, m = acc["b"], acc["m"]

        def around(low: Column, first: Column) -> Column:
            part = F.slice(b, first + 1, F.lit(4))
            inner = F.struct(F.flatten(F.transform(part, lambda x: x["p"])).alias("p"), F.flatten(F.transform(part, lambda x: x["r"])).alias("r"))
            made = _let(inner, lambda w: _let(_place(w["r"], low), lambda i: _merge(w["p"], w["r"], i, table)))
            anew = _let(made, lambda w: dealt(w, F.ceil(F.size(w["p"]) / 4).cast("int")))
            return _let(anew, lambda x: F.struct(
                F.concat(F.slice(b, F.lit(1), first), x, F.slice(b, first + 5, n)).alias("b"),
                F.concat(F.slice(m, F.lit(1), first), least(x), F.slice(m, first + 5, n)).alias("m"),
            ))

        merge = lambda low: F.when(low == NONE, acc).otherwise(_let(F.greatest(_place(m, low) - 1, F.lit(0)), lambda first: around(low, first)))
        return _let(F.array_min(m), merge)

    start = _let(F.struct(p.alias("p"), _ranks(p, table).alias("r")), lambda x: dealt(x, F.ceil(F.sqrt(n / 10)).cast("int")))
    return F.flatten(F.transform(F.aggregate(F.sequence(F.lit(1), n - 1), _let(start, state), step)["b"], lambda x: x["p"]))


def encoded_word(word: Column, table: Table) -> Column:
    """The ids of a word (binary, not empty), as array<int>."""

    def of(h: Column) -> Column:
        pieces = F.regexp_extract_all(h, F.lit(".."), F.lit(0))
        folded = _let(pieces, lambda p: F.transform(F.when(F.size(p) > LONG, _folded_in_blocks(p, table)).otherwise(_folded(p, table)), table.rank))
        return _let(table.rank(h), lambda whole: F.when((whole != NONE) | (F.length(h) <= 2), F.array(whole)).otherwise(folded))

    return _let(F.hex(word), of)


def encoded_words(words: Column, table: Table) -> Column:
    """Of each word (binary) the ids as text, joined by commas."""

    def all_of(slots: Column) -> Column:
        known = table.bound(slots)
        return F.transform(words, lambda w: F.array_join(encoded_word(w, known), ","))

    return _let(table.slots, all_of)


def decoded(ids: Column, table: Table) -> Column:
    """The bytes of ids."""
    return F.unhex(F.array_join(F.transform(ids, table.piece), ""))


def _packed(values: list[bytes]) -> bytes:
    """Byte strings: their number, their lengths and their bytes, compressed."""
    sizes = np.fromiter(map(len, values), "<u4", len(values))
    return zstandard.compress(len(values).to_bytes(8, "little") + _planes(sizes) + b"".join(values), 1)


def _unpacked(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    ends = (np.cumsum(_from_planes(raw[8 : 8 + 4 * n]), dtype=np.int64) + 8 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([8 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def _planes(x: np.ndarray) -> bytes:
    """32-bit integers with equal bytes of all side by side, which compress better."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _buckets(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words by bucket, and the bounds of the buckets among them."""
    of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


CHUNKS = "chunk long, ids array<long>, ends array<long>, places binary, words binary"


def chunks(docs: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """Dictionary-encoded chunks: ids and last word's index of each document,
    word places and the distinct words, packed."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("places", pa.binary()), ("words", pa.binary())])
        here, made, find = TaskContext.get().partitionId(), 0, regex.compile(pattern).findall

        def numbering() -> defaultdict[str, int]:
            """Distinct words, numbered as they come."""
            known: defaultdict[str, int] = defaultdict()
            known.default_factory = known.__len__
            return known

        def row():
            at = np.concatenate(places)
            # frequent words first: their places are small, which compresses better
            order = np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order), dtype="<u4")
            words = [w.encode() for w in known]
            return pa.RecordBatch.from_pylist([{"chunk": (here << 32) + made, "ids": ids, "ends": ends, "places": zstandard.compress(_planes(rank[at]), 1), "words": _packed([words[i] for i in order.tolist()])}], schema=schema)

        ids, ends, places, known, chars, n = [], [], [], numbering(), 0, 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or ""
                at = find(t)
                places.append(np.fromiter(map(known.__getitem__, at), "<u4", len(at)))
                n += len(at)
                ids.append(i)
                ends.append(n)
                chars += len(t)
                if chars >= CHUNK_CHARS:
                    yield row()
                    made += 1
                    ids, ends, places, known, chars, n = [], [], [], numbering(), 0, 0
        if ids:
            yield row()

    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(split, CHUNKS)


ASKS = "bucket int, chunk long, words binary"


def _ask(buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        rows = []
        for r in table.select(["chunk", "words"]).to_pylist():
            words = _unpacked(r["words"])
            order, bounds = _buckets(words, buckets)
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                rows.append({"bucket": p, "chunk": r["chunk"], "words": _packed([words[i] for i in order[bounds[p] : bounds[p + 1]].tolist()])})
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary())]))

    return ask


def _distinct(table: pa.Table) -> pa.Table:
    """A bucket's distinct words, some in each row."""
    known: dict[bytes, None] = {}
    for blob in table.column("words"):
        known.update(dict.fromkeys(_unpacked(blob.as_py())))
    words, p = list(known), table.column("bucket")[0].as_py()
    parts = [words[i : i + BATCH_WORDS] for i in range(0, len(words), BATCH_WORDS)]
    return pa.table({"bucket": pa.array([p] * len(parts), pa.int32()), "words": pa.array(parts, pa.list_(pa.binary()))})


def _answer(asks: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """For each chunk, the ids of the words it asked for, as text."""
    code: dict[bytes, bytes] = {}
    for words, ids in zip(vocabulary.column("words"), vocabulary.column("ids"), strict=True):
        code.update(zip(words.values.to_pylist(), ids.values.cast(pa.binary()).to_pylist(), strict=True))
    rows = [{"chunk": r["chunk"], "bucket": r["bucket"], "ids": _packed([code[w] for w in _unpacked(r["words"])])} for r in asks.to_pylist()]
    return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())]))


def _gather(buckets: int, ranks: dict[bytes, int], id_col: str, keep_ids: bool):
    pieces = {str(r).encode(): p for p, r in ranks.items()}

    def gather(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if keep_ids else 4]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        (row,) = chunk.to_pylist()
        words = _unpacked(row["words"])
        order, bounds = _buckets(words, buckets)
        codes: list[bytes] = [b""] * len(words)
        for r in answers.to_pylist():
            for i, c in zip(order[bounds[r["bucket"]] : bounds[r["bucket"] + 1]].tolist(), _unpacked(r["ids"]), strict=True):
                codes[i] = c
        raws = [b"".join([pieces[x] for x in c.split(b",")]) for c in codes]
        count = np.fromiter((c.count(b",") + 1 for c in codes), np.int64, len(codes))
        at = _from_planes(zstandard.decompress(row["places"]))
        out, start = [], 0
        for i, end in zip(row["ids"], row["ends"], strict=True):
            here = at[start:end]
            place = here.tolist()
            text, raw = b",".join([codes[k] for k in place]), b"".join([raws[k] for k in place])
            out.append((i, int(count[here].sum()), hashlib.sha256(text).hexdigest(), hashlib.sha256(raw).hexdigest()) + (([int(x) for x in text.split(b",")] if text else [], raw) if keep_ids else ()))
            start = end
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*out, strict=True), kinds, strict=False)})

    return gather


def tokenize(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row per document: ``n_tokens``, ``ids_sha256`` of the decimal ids
    joined by commas, ``decoded_sha256`` of the bytes they decode to, and with
    ``keep_ids`` the ids themselves and the decoded bytes."""
    table = Table(ranks)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(text_bytes(docs, text_col) / BUCKET_BYTES))
    whole = chunks(docs, pattern, id_col, text_col).groupBy("chunk")  # one exchange, read by both uses
    asks = whole.applyInArrow(_ask(buckets), ASKS).groupBy("bucket")
    words = asks.applyInArrow(_distinct, "bucket int, words array<binary>")
    coded = words.withColumn("ids", encoded_words(F.col("words"), table))
    answers = asks.cogroup(coded.groupBy("bucket")).applyInArrow(_answer, "chunk long, bucket int, ids binary")
    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep_ids else "")
    return whole.cogroup(answers.groupBy("chunk")).applyInArrow(_gather(buckets, ranks, id_col, keep_ids), schema)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokenize(docs, load_ranks(public_tokenizers.path(FILE)), public_tokenizers.PATTERN)
