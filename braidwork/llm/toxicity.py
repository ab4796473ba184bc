"""Toxicity by logistic regression on hashed n-grams and skip-grams, fitted by FTRL-proximal."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

#: Hashed features; weights are sent out sparse, at most so many.
BUCKETS = 1 << 22
#: Labelled rows that a fit sees at most, the least by a hash of doc_id: the documented bound of the sample.
TRAIN_ROWS = 24_000
THRESHOLD = 0.7
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters are lowered and ASCII punctuation parts words.
_PLAIN = bytes(32 if (33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127) else c for c in range(256))


@dataclass(frozen=True)
class Model:
    """Non-zero weights by bucket, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        t = np.zeros(BUCKETS, dtype=np.float32)
        t[self.index] = self.weight
        return t


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_WORDS = _Words()


def features(text: str | None) -> np.ndarray:
    """Buckets of a whole text's words, pairs of neighbours, and pairs with one or two words between."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_PLAIN).split()
    u = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    found = [u]
    for gap in (1, 2, 3):
        if len(u) > gap:
            x = (u[:-gap] * np.uint64(2 * gap + 1)) ^ (u[gap:] + np.uint64(gap)) * _MIX
            found.append(x ^ (x >> np.uint64(31)))
    return ((np.concatenate(found) * _MIX) >> np.uint64(42)).astype(np.int32)


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 5.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1, epochs: int = 4, seed: int = 5) -> Model:
    """FTRL-proximal: a learning rate for each coordinate, and exact zeros by the L1 term."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    draw = np.random.default_rng(seed)

    def at(i: np.ndarray) -> np.ndarray:
        held = np.where(i == BUCKETS, 0.0, l1)  # the bias is not shrunk
        return np.where(np.abs(z[i]) <= held, 0.0, -(z[i] - np.sign(z[i]) * held) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            i = np.append(rows[k], BUCKETS)
            w = at(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    kept = np.flatnonzero(np.abs(z[:-1]) > l1)
    return Model(kept.astype(np.int32), at(kept).astype(np.float32), float(at(np.array([BUCKETS]))[0]))


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The numbers that each binary value holds, where they lie."""
    out = []
    for chunk in column.chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            data = np.frombuffer(chunk.buffers()[2] or b"", dtype=np.uint8)
            out += [data[a:b].view(np.int32) for a, b in zip(ends.tolist(), ends[1:].tolist())]
    return out


def fit(documents: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from at most TRAIN_ROWS of the labelled rows for which ``usable`` (of the key) holds.

    Features are made where the documents are; one task of an executor fits. Rows with a null key
    or label teach nothing; of several labels of one key the highest counts. Null and empty texts have no
    features; of a very long one all words count. Rows that repeat teach once each. No labelled row: no
    weights. Other columns of either table do not matter.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & usable).groupBy(key).agg(F.max(label).cast("double").alias("_bw_y"))
    sample = known.orderBy(F.xxhash64(key), key).limit(TRAIN_ROWS)  # bounded by TRAIN_ROWS
    rows = documents.select(F.col(key), F.col(text)).join(F.broadcast(sample), key).select(key, "_bw_y", text)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.unique(features(t)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["key", "y", "x"])

    def train(group: pa.Table) -> pa.Table:
        keys, rows = group["key"].to_pylist(), _views(group["x"])  # no copy is made of what is large
        times = Counter(keys)
        order = sorted(range(len(rows)), key=lambda i: (keys[i], rows[i].tobytes() if times[keys[i]] > 1 else b""))
        model = fit_ftrl([rows[i] for i in order], group["y"].to_numpy()[order])
        del group, rows
        release()
        return pa.table({"i": np.append(model.index, -1).astype(np.int32), "w": np.append(model.weight, model.bias).astype(np.float64)})

    made = rows.mapInArrow(featurise, f"key {documents.schema[key].dataType.simpleString()}, y double, x binary")
    weights = made.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(train, "i int, w double").collect()  # at most BUCKETS + 1
    index = np.array([r.i for r in weights if r.i >= 0], dtype=np.int32)
    return Model(index, np.array([r.w for r in weights if r.i >= 0], dtype=np.float32), sum(r.w for r in weights if r.i < 0))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``: the probability that the whole text is toxic.

    Null counts as the empty text; very long texts are scored whole; rows that repeat are each scored
    alike. Other columns pass through; one named like ``out`` is replaced. Empty input: no rows.
    """
    told = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            table = told.value.table() if table is None else table
            texts = b.column(b.schema.get_field_index("_bw_text")).to_pylist()
            sums = np.array([_sum(table, features(t)) for t in texts], dtype=np.float64) + told.value.bias
            made = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made)], names=[*names, "_bw_score"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out]
    texted = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("_bw_text"))
    return texted.mapInArrow(run, ", ".join([*kinds, "_bw_score double"])).withColumnRenamed("_bw_score", out)


def _sum(table: np.ndarray, found: np.ndarray) -> float:
    """Of the weights of the distinct features; only those with a weight need to be told apart."""
    hit = found[table[found] != 0]
    return float(table[np.unique(hit)].sum(dtype=np.float64))


def in_remainder(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; a null key does."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def reject_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those scored at THRESHOLD or more; all columns as they were.

    Null and empty texts score as the bias does and stay unless that alone is toxic; rows that repeat share
    a fate, whatever their keys, null ones too. Empty input: no rows.
    """
    model = fit(documents, labels, ~in_remainder("doc_id", 3, 1))
    return score(documents, model, out="_bw_toxic").where(F.col("_bw_toxic") < THRESHOLD).drop("_bw_toxic")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document's score, and whether it was kept out of learning."""
    model = fit(documents, labels, ~in_remainder("doc_id", 3, 1))
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", in_remainder("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
