"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 1024
END_ID = 2
#: Texts that hold the mark of a special token go to the slower library; on all other text the two give the same ids.
SLOW = re.compile(r"<\|")


@cache
def _encoders(tokenizer: str, ranks: str | None):
    """The tokenizer of the file and, where the same vocabulary is at hand as ranks, a faster one with the same ids."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer)
    fast = None
    if ranks:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return exact, fast


def encode(text: str | None, tokenizer: str, ranks: str | None = None) -> list[int]:
    """Ids of a whole text as the tokenizer file has them, without special tokens added."""
    if not text:
        return []
    exact, fast = _encoders(tokenizer, ranks)
    if fast is not None and not SLOW.search(text):
        return fast.encode_ordinary(text)
    return exact.encode(text, add_special_tokens=False).ids


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenised documents, the longer ones cut: all pieces but the first have ``capacity`` tokens.

    ``part`` and ``nth`` number the pieces of a length within the task that made them; they hold
    only once written.
    """
    if tokenizer is None:
        tokenizer, ranks = default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                keys, out = b.column(0).slice(at, 256), []
                for row, t in enumerate(b.column(1).slice(at, 256).to_pylist()):
                    ids = np.array([*encode(t, tokenizer, ranks), end_id], dtype="<u4")
                    start, n = 0, len(ids)
                    for k in range(-(-n // capacity)):
                        end = start + ((n - 1) % capacity + 1 if k == 0 else capacity)
                        out.append((row, k, start, end - start, zlib.crc32(ids[start:end].tobytes()), part, seen[end - start], ids[start:end].tolist() if with_ids else None))
                        seen[end - start] += 1
                        start = end
                rows = list(zip(*out))
                arrays = [keys.take(pa.array(rows[0])), *[pa.array(rows[i], pa.int64()) for i in range(1, 7)]]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(rows[7], pa.list_(pa.int64()))] if with_ids else []), names=["key", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids])

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece long, start long, length long, ids_crc32 long, part long, nth long" + ", ids array<long>" * with_ids
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


class _Capacities:
    """A segment tree over remaining capacities: each node tells whether a bin below it is open."""

    def __init__(self, capacity: int):
        self.half = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.half)

    def put(self, at: int, is_open: bool) -> None:
        at += self.half
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity that is at least ``least``."""
        at = least + self.half
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.half:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.half
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``counts`` pieces of each length, as runs of pieces and bins.

    A run (length, lo, hi, first, each, offset) puts the pieces lo to hi-1 of that length, ``each``
    in a bin, into the bins from ``first`` on, from ``offset`` on. It is what placing piece by piece
    gives: pieces of a length are alike, and a bin that has taken one stays the tightest while
    another fits. Runs are bounded by the square of the capacity, not by the pieces.
    """
    tree, bins, made, runs = _Capacities(capacity), {}, 0, []

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            bins.setdefault(room, []).append((first, n))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        placed, total = 0, counts[length]
        while placed < total:
            room = tree.tightest(length)
            if room is None:
                room, need = capacity, -(-(total - placed) // (capacity // length))
                first, n = made, need
                made += need
            else:
                first, n = bins[room].pop()
                if not bins[room]:
                    tree.put(room, False)
            each = room // length
            full = min(n, (total - placed) // each)
            if full:
                runs.append((length, placed, placed + full * each, first, each, capacity - room))
                placed += full * each
                keep(room - each * length, first, full)
            if full < n and placed < total:  # the last pieces do not fill the next bin
                rest = total - placed
                runs.append((length, placed, total, first + full, rest, capacity - room))
                keep(room - rest * length, first + full, 1)
                placed, full = total, full + 1
            keep(room, first + full, n - full)
    return runs


def pack(df: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", **options) -> DataFrame:
    """Each piece of each document with its ``sequence_id`` and ``offset`` there.

    Tokenising is distributed and written once. Only how many pieces each length has (at most
    ``capacity`` numbers) goes to the driver, which packs lengths, not pieces, by :func:`plan`; a piece
    finds its place from its rank among the pieces of its length, which is its number within its
    task plus those of earlier tasks. So the packing is that of one best-fit-decreasing run over
    all pieces. A null or empty text is the end token alone; null or repeated keys are packed like
    any others; empty input: no rows. Options are those of :func:`pieces`.
    """
    cut = materialize(pieces(df, capacity, key=key, **options), "pack-pieces")
    per = materialize(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, list[tuple]] = {}
    for run in plan(counts, capacity):
        by_length.setdefault(run[0], []).append(run)
    tables = {k: np.array(sorted(v), dtype=np.int64).T for k, v in by_length.items()}
    told = df.sparkSession.sparkContext.broadcast(tables)  # at most capacity squared runs
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    schema = ranked.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                _, lo, _, first, each, offset = told.value[k]
                i = np.searchsorted(lo, rank[at], side="right") - 1
                nth = rank[at] - lo[i]
                seq[at], off[at] = first[i] + nth // each[i], offset[i] + nth % each[i] * k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(off)], names=[*b.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    out = ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")
    ids = ["ids"] if "ids" in schema.names else []
    return out.select(F.col("key").alias(key), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset", *ids)


def sequences(df: DataFrame, **options) -> DataFrame:
    """``sequence_id`` and ``input_ids``: what a training run reads, at most ``capacity`` ids a row."""
    packed = pack(df, with_ids=True, **options)
    together = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return together.select("sequence_id", F.flatten("held.ids").alias("input_ids"))


def digest(documents: DataFrame) -> DataFrame:
    return pack(documents)
