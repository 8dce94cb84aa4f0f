"""Quality classifier with hierarchical empirical Bayes over sites.

Two heads, *good* and *toxic*, give each document a log-odds. They are fitted
on the driver from at most ``MAX_LABELLED`` labelled documents that there are,
those with the least hash of their id, until they have ``MAX_FIT_CHARS``
characters together (one of over ``MAX_TEXT_CHARS`` is passed over): good from
shape features, toxic from a hashed lexicon of words and word beginnings. Both
models have a fixed size. Everything else covers all documents.

Document evidence is combined with where the document comes from. Expected
good and toxic shares are aggregated by host and by path within host; a host's
share is shrunk toward the global share, a path's toward its host's, each with
a strength estimated from the variance between sites. A sparse site so gets the
global prior, a large one its own. The posterior log-odds are the document's
own, moved by how far its path's prior odds are from the global ones.

Defined cases: a null or empty text has no words and is rejected as not good;
null hosts or paths are sites of their own; labels that disagree count by
majority, ties as not good and as toxic; without labels of both kinds a head
gives its label's smoothed share to all; rows that repeat or share an id are
judged each by its own text; texts of any length are scored whole; an empty
table gives no rows; other columns pass through, whatever their names, but those
named ``p_good``, ``p_toxic`` or ``keep`` are replaced.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import durable

MAX_LABELLED = 6_000
MAX_FIT_CHARS = 48_000_000
MAX_TEXT_CHARS = 8_000_000
#: Buckets of the lexicon; its size does not depend on the data.
BUCKETS = 1 << 20
#: Sites up to which their table is broadcast (some 10 MB); beyond, it is joined by exchange.
BROADCAST_SITES = 100_000
_WORD = re.compile(r"\w+")
_MARKED = re.compile(r"[^\w\s]{2,}(?!\S)")
#: Bytes of a word's beginnings.
_PREFIXES = (3, 4, 5, 6, 7, 8)
TOP = 5
SHAPES = 10


def word_features(word: str) -> list[int]:
    """Buckets of a word: itself and its beginnings."""
    b = word.encode()
    return [zlib.crc32(b, 1) % BUCKETS, *[zlib.crc32(b[:k]) % BUCKETS for k in _PREFIXES if len(b) > k]]


def look(text: str) -> tuple[list[float], set[str]]:
    """Shape features that tell prose from tables, symbol runs and repeats,
    and the distinct words."""
    parts = text.split()
    n = len(parts)
    words = _WORD.findall(text.lower())
    if not n:
        return [0.0] * SHAPES, set()
    repeated = 1 - len(set(parts)) / n
    same = sum(map(operator.eq, parts, parts[1:]))
    odd = sum(map(len, parts)) - sum(map(len, words))
    lines = text.split("\n")
    digits = sum(map(text.count, "0123456789"))
    shape = [math.log1p(n), repeated, repeated * math.log1p(n), same / n, odd / len(text), parts.count("|") / n, len(_MARKED.findall(text)) / n, len(text) / n, digits / len(text), 1 - len(set(lines)) / len(lines)]
    return shape, set(words)


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-4):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z = self._z(x)
        penalty = ridge * len(x) * np.eye(z.shape[1])
        penalty[-1, -1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (p - y) + penalty @ w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.mean) / self.std, -20, 20), np.ones(len(x))]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -20, 20)


class Features:
    """A document's distinct words as runs of buckets."""

    def __init__(self, words: set[str]):
        runs = [word_features(w) for w in sorted(words)]
        self.start = np.cumsum([0, *map(len, runs[:-1])], dtype=np.int32) if runs else np.zeros(0, np.int32)
        self.bucket = np.array([f for r in runs for f in r], np.int32)

    def scores(self, weight: np.ndarray) -> list[float]:
        return np.maximum.reduceat(weight[self.bucket], self.start).tolist() if len(self.start) else []


class Lexicon:
    """Smoothed log-odds of each bucket over documents that hold it."""

    def __init__(self, documents: list[Features], y: np.ndarray):
        seen, bad = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
        for d, toxic in zip(documents, y, strict=True):
            at = np.unique(d.bucket)
            seen[at] += 1
            if toxic:
                bad[at] += 1
        p = (y.sum() + 0.5) / (len(y) + 1)
        odds = np.log((bad + 2 * p) / (seen - bad + 2 * (1 - p))) - math.log(p / (1 - p))
        self.weight = np.where(seen >= 3, odds, 0).astype(np.float32)

    def word(self, word: str) -> float:
        return max(map(self.weight.item, word_features(word)))


def evidence(scores: list[float]) -> list[float]:
    """Features of a document from its distinct words' scores."""
    high = [s for s in scores if s > 0.5]
    top = (sorted(high, reverse=True)[:TOP] + [0.0] * TOP)[:TOP]
    return [*top, sum(s for s in high if s > 2), math.log1p(len(scores))]


class Model:
    """Both heads; ``constant`` holds the log-odds of a head that could not be fitted."""

    def __init__(self, texts: list[str], good: np.ndarray, toxic: np.ndarray):
        self.constant = {k: None if 0 < y.sum() < len(y) else math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) for k, y in (("good", good), ("toxic", toxic))}
        shapes, features = [], []
        for t in texts:
            s, words = look(t)
            shapes.append(s)
            features.append(Features(words))
        if self.constant["good"] is None:
            self.good = Logistic(np.array(shapes), good)
        self.lexicon = None
        if self.constant["toxic"] is None:
            # evidence is fitted on documents that the lexicon has not seen
            half = np.arange(len(texts)) % 2 == 0
            x = np.zeros((len(texts), TOP + 2))
            for part in (half, ~half):
                if 0 < toxic[~part].sum():
                    lex = Lexicon([f for f, p in zip(features, part, strict=True) if not p], toxic[~part])
                    for i in np.flatnonzero(part):
                        x[i] = evidence(features[i].scores(lex.weight))
            self.toxic = Logistic(x, toxic, 1e-3)
            self.lexicon = Lexicon(features, toxic)

    def logits(self, texts: list[str], cache: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        shapes, rows = [], []
        for t in texts:
            s, words = look(t)
            shapes.append(s)
            if self.lexicon is not None:
                for w in [w for w in words if w not in cache]:
                    cache[w] = self.lexicon.word(w)
                rows.append(evidence(list(map(cache.__getitem__, words))))
                if len(cache) > 400_000:
                    cache.clear()
        good = self.good.logit(np.array(shapes)) if self.constant["good"] is None else np.full(n, self.constant["good"])
        good = np.where(np.array([not t.strip() for t in texts]), -20.0, good)
        return good, self.toxic.logit(np.array(rows)) if self.lexicon is not None else np.full(n, self.constant["toxic"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> Model:
    """A model from at most ``limit`` labelled documents."""
    known = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__label_id"))
        .agg((F.avg("quality") > 0.5).alias("good"), (F.avg("toxic") >= 0.5).alias("toxic"))
        .where("good IS NOT NULL AND toxic IS NOT NULL")
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).where("__text IS NOT NULL")
    # lengths only: which labelled ids have texts, and how many characters together
    held = texts.select("__id", F.length("__text").cast("long").alias("n")).join(known, F.col("__id") == F.col("__label_id"))
    held = held.groupBy("__label_id", "good", "toxic").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("copies"))
    held = held.where((F.col("chars") <= MAX_TEXT_CHARS) & (F.col("copies") <= limit))
    chosen, chars, copies = [], 0, 0
    for r in held.orderBy(F.xxhash64("__label_id"), "__label_id").limit(limit).collect():
        chars, copies = chars + r["chars"], copies + r["copies"]
        if chars > MAX_FIT_CHARS or copies > 2 * limit:
            break
        chosen.append((r["__label_id"], r["good"], r["toxic"]))
    picked = docs.sparkSession.createDataFrame(chosen, T.StructType([held.schema[c] for c in ("__label_id", "good", "toxic")]))
    # at most ``limit`` rows are broadcast, and the texts of these ids collected
    rows = texts.join(F.broadcast(picked), F.col("__id") == F.col("__label_id")).select("__id", "__text", "good", "toxic").collect()
    rows = sorted(rows, key=lambda r: (r["__id"], r["__text"]))
    y = lambda k: np.array([r[k] for r in rows], float)
    return Model([r["__text"] for r in rows], y("good"), y("toxic"))


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``__good`` and ``__toxic``, the document's own log-odds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    out = [i for i, c in enumerate(names) if keep_text or c != text_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [t or "" for t in part.column(names.index(text_col)).to_pylist()]
                good, toxic = shared.value.logits(texts, cache)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in out], pa.array(good, pa.float64()), pa.array(toxic, pa.float64())], names=[*[names[i] for i in out], "__good", "__toxic"])

    schema = T.StructType([*[docs.schema.fields[i] for i in out], T.StructField("__good", T.DoubleType()), T.StructField("__toxic", T.DoubleType())])
    return docs.mapInArrow(score, schema)


def _sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def _logit(c: Column) -> Column:
    p = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(total: float, squares: float, spread: float, sites: int, mean: float, levels: float = 1.0) -> float:
    """Pseudo-count of the prior: within-site over between-site variance."""
    within = max(mean * (1 - mean), 1e-9)
    size = total - squares / total if total else 0.0
    if sites < 2 or size <= 0:
        return 1e6
    between = (spread - (sites - 1) * within) / size
    return min(1e6, within / between) if between > 1e-12 else 1e6


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, dict[str, float], int]:
    """From ``__host, __path, __good, __toxic``: shrunken shares by host and
    path, the global shares, and the number of sites."""
    heads = ("good", "toxic")
    paths = rows.groupBy("__host", "__path").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(_sigmoid(F.col(f"__{h}"))).alias(h) for h in heads])
    paths = durable(paths)
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("hn"), *[F.sum(h).alias(f"h_{h}") for h in heads])
    whole = paths.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"), F.sum(F.col("n") * F.col("n")).alias("n2"), *[F.sum(h).alias(h) for h in heads]).first()
    total = whole["n"] or 0.0
    mean = {h: (whole[h] or 0.0) / total if total else 0.5 for h in heads}
    by_host = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("hn") * F.col("hn")).alias("n2"), *[F.sum(F.col("hn") * F.pow(F.col(f"h_{h}") / F.col("hn") - mean[h], 2)).alias(h) for h in heads]).first()
    joined = paths.join(hosts, paths["__host"].eqNullSafe(hosts["__host"])).drop(hosts["__host"])
    within = joined.agg(*[F.sum(F.col("n") * F.pow(F.col(h) / F.col("n") - F.col(f"h_{h}") / F.col("hn"), 2)).alias(h) for h in heads]).first()
    out = joined
    for h in heads:
        kh = _strength(total, by_host["n2"] or 0.0, by_host[h] or 0.0, by_host["k"], mean[h])
        kp = _strength(total, whole["n2"] or 0.0, within[h] or 0.0, whole["sites"] - by_host["k"] + 1, mean[h])
        host = (F.col(f"h_{h}") + kh * mean[h]) / (F.col("hn") + kh)
        out = out.withColumn(f"__site_{h}", (F.col(h) + kp * host) / (F.col("n") + kp))
    return out.select("__host", "__path", *[f"__site_{h}" for h in heads]), mean, int(whole["sites"])


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``p_good``, ``p_toxic`` (posteriors) and ``keep``.

    Texts are scored once; the scores are written, and with ``keep_text`` the
    texts with them, before sites are summed up and joined.
    """
    model = fit(docs, labels, id_col, text_col)
    # columns by place, so that no name can clash
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], host.alias("__host"), path.alias("__path"))
    columns = [c for c in docs.columns if c not in ("p_good", "p_toxic", "keep") and (keep_text or c != text_col)]
    rows = durable(scored(plain, model, names[text_col], keep_text))
    sites, mean, n_sites = site_posteriors(rows.select("__host", "__path", "__good", "__toxic"))
    sites = sites.withColumnsRenamed({"__host": "__h", "__path": "__p"})
    if n_sites <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    out = rows.join(sites, F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__p")), "left")
    p = {}
    for h in ("good", "toxic"):
        prior = math.log(max(mean[h], 1e-6) / max(1 - mean[h], 1e-6))
        p[h] = _sigmoid(F.col(f"__{h}") + _logit(F.col(f"__site_{h}")) - F.lit(prior))
    keep = (p["good"] >= 0.5) & (p["toxic"] < 0.5)
    return out.select(*[F.col(names[c]).alias(c) for c in columns], p["good"].alias("p_good"), p["toxic"].alias("p_toxic"), keep.alias("keep"))


def classify_documents(docs: DataFrame, labels: DataFrame, keep_text: bool = True) -> DataFrame:
    """Documents by source (the host) and by language within it (the path)."""
    return classify(docs, labels, F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang")), keep_text=keep_text)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify_documents(docs, labels, keep_text=False).select("doc_id", "p_good", "p_toxic", "keep")
