"""Chunks of a corpus ask a table that lies in partitions: numbers go out sorted and packed, answers come back in order.

A chunk sends a message to each partition that has any of its distinct keys, and a key reaches its
partition once from each chunk, however common it is. That makes chunks times partitions messages, which
grow as the square of the corpus. So where partitions are many, a message goes to a region of them
instead, as many regions as there are partitions in each. There the messages of a block of chunks become
one to each partition, the keys they share once only, and what is answered to a block is dealt out to
its chunks in the same place. Messages then grow as the power 1.5, and each stays hundreds of keys long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .words import mix

#: Partitions at least, and keys of all chunks that one of more should get, about.
LEAST_PARTS, PART_KEYS = 64, 2_000_000
#: Partitions up to which chunks write to them straight.
STRAIGHT_PARTS = 512


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each for a process: messages are small and many, and making these costs more than using them."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane; a byte in front tells how many planes there are, those above are zero."""
    x = np.ascontiguousarray(x)
    highest = int(x.view(f"u{x.itemsize}").max()) if len(x) else 0
    planes = -(-highest.bit_length() // 8) if len(x) else 0
    if not planes and len(x):
        planes = 1  # it tells the length
    return bytes([planes]) + _zstd()[0].compress(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :planes].T.tobytes())


def unpacked(b: bytes, kind: str) -> np.ndarray:
    planes, raw, kind = b[0], np.frombuffer(_zstd()[1].decompress(memoryview(b)[1:]), dtype=np.uint8), np.dtype(kind)
    if not planes:
        return np.zeros(0, dtype=kind)
    out = np.zeros((len(raw) // planes, kind.itemsize), dtype=np.uint8)
    out[:, :planes] = raw.reshape(planes, len(out)).T
    return out.view(kind).reshape(-1)


def rising(x: np.ndarray) -> bytes:
    """Sorted numbers, by their differences."""
    return packed(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def risen(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, "u8"), dtype=np.uint64)


def parts_for(keys: int) -> int:
    return max(LEAST_PARTS, -(-keys // PART_KEYS))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(33)).astype(np.int64)) % parts


def cuts(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the runs of a sorted array."""
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for lo, hi in zip(first, [*first[1:], len(part)]):
        yield int(part[lo]), int(lo), int(hi)


def part_in_order(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partitions that are ranges of numbers, for keys that are spread evenly over 64 bits: sorted keys lie by partition."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def width_for(parts: int) -> int:
    """Partitions of a region; 1: no regions."""
    return 1 if parts <= STRAIGHT_PARTS else isqrt(parts)


@dataclass(frozen=True)
class Form:
    """What a message holds: ``fields`` of bytes, for distinct keys of one or more columns and a number for each.

    ``opened`` gives the keys' columns and the numbers of one message, ``shut`` is its inverse; ``distinct``
    gives where each distinct key is found, in order, and which one each key is; ``part`` is the keys' partition.
    """

    fields: list[str]
    opened: Callable[..., tuple[list[np.ndarray], np.ndarray]]
    shut: Callable[[list[np.ndarray], np.ndarray], tuple[bytes, ...]]
    distinct: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]
    part: Callable[[list[np.ndarray]], np.ndarray]

    @property
    def schema(self) -> str:
        return "part int, chunk long, " + ", ".join(f"{f} binary" for f in self.fields)

    def messages(self, chunk: int, region: np.ndarray, columns: list[np.ndarray], number: np.ndarray) -> pa.RecordBatch | None:
        """One to each region, or to each partition; keys are given by it and then in order."""
        sent = [(p, *self.shut([c[lo:hi] for c in columns], number[lo:hi])) for p, lo, hi in cuts(region)]
        if not sent:
            return None
        p, *fields = zip(*sent)
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([chunk] * len(p), pa.int64()), *[pa.array(f, pa.binary()) for f in fields]], names=["part", "chunk", *self.fields])

    def all(self, t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Keys and numbers of all messages one after another, and where each message ends."""
        keys, numbers = zip(*(self.opened(*(x.as_py() for x in row)) for row in zip(*(t[f] for f in self.fields))))
        held = [list(c) for c in zip(*keys)]
        del keys
        columns = []
        while held:  # a column's pieces go when it is whole
            columns.append(np.concatenate(held.pop(0)))
        return columns, np.concatenate(numbers), np.cumsum([len(n) for n in numbers])

    def met(self, t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(columns, numbers, part, which, ends): the distinct keys of all messages, by partition and then in order, their numbers summed up; which one each key is; where each message ends."""
        columns, number, ends = self.all(t)
        first, which = self.distinct(columns)
        columns = [c[first] for c in columns]
        part = self.part(columns)
        order = np.argsort(part, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        total = np.bincount(which, weights=number, minlength=len(first))
        return [c[order] for c in columns], total[order], part[order], back[which], ends


def _blocks(asked: DataFrame, width: int) -> DataFrame:
    """With ``block``: as many blocks of chunks as a region has partitions, so that a block has about as many keys for a region as a partition has in all."""
    return asked.withColumn("block", F.pmod(F.xxhash64("chunk"), F.lit(width)))


def folded(asked: DataFrame, form: Form, width: int) -> DataFrame:
    """From messages of chunks to regions, those of blocks to partitions; ``chunk`` is the block."""

    def fold(t: pa.Table) -> pa.Table:
        release()
        columns, number, part, _, _ = form.met(t)
        return pa.Table.from_batches([form.messages(t["block"][0].as_py(), part, columns, number)])

    return _blocks(asked, width).groupBy("part", "block").applyInArrow(fold, form.schema)


def unfolded(asked: DataFrame, answers: DataFrame, form: Form, width: int, read: Callable[[pa.Table], np.ndarray], write: Callable[[np.ndarray], tuple[bytes, ...]]) -> DataFrame:
    """What was answered to blocks by partitions, as answers to chunks by regions, each in the order of the chunk's message.

    ``read`` makes one array of all that a block was answered, by partition; ``write`` makes the fields of an answer.
    """
    fields = [c for c in answers.columns if c not in ("chunk", "part")]

    def deal(t: pa.Table, got: pa.Table) -> pa.Table:
        release()
        _, _, _, which, ends = form.met(t)
        made = zip(*[write(x) for x in np.split(read(got)[which], ends[:-1])])
        return pa.table({"chunk": t["chunk"].combine_chunks(), "part": t["part"].combine_chunks(), **{f: pa.array(x, pa.binary()) for f, x in zip(fields, made)}})

    back = answers.withColumnRenamed("chunk", "block").withColumn("region", F.expr(f"cast(part div {width} as int)"))
    both = _blocks(asked, width).groupBy("part", "block").cogroup(back.groupBy("region", "block"))
    return both.applyInArrow(deal, "chunk long, part int, " + ", ".join(f"{f} binary" for f in fields))


def _name_form(parts: int) -> Form:
    """Keys, and whether each occurs more than once."""

    def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(columns[0], return_index=True, return_inverse=True)[1:]

    return Form(
        ["keys", "many"],
        lambda keys, many: ([np.cumsum(_plain(keys), dtype=np.uint64)], 1.0 + np.frombuffer(many, dtype=np.uint8)),
        lambda columns, times: (_planes(np.diff(columns[0], prepend=np.uint64(0))), (times > 1).astype(np.uint8).tobytes()),
        distinct,
        lambda columns: part_in_order(columns[0], parts),
    )


def _planes(x: np.ndarray) -> bytes:
    """The lower bytes of 64-bit numbers, as many as the highest needs, whose count stands in front; nothing is compressed."""
    n = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([n]) + x.view(np.uint8).reshape(len(x), 8)[:, :n].tobytes()


def _plain(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, dtype=np.uint8, offset=1).reshape(-1, b[0])
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, : b[0]] = raw
    return out.view(np.uint64).reshape(-1)


#: The column of what a chunk asks: its messages, by partition (or region).
ASKED = "asked array<struct<part: int, keys: binary, many: binary>>"


def asked(keys: np.ndarray, parts: int, width: int) -> tuple[pa.Array, np.ndarray]:
    """What a chunk asks of ``parts`` partitions in regions of ``width``, as one value of the column ASKED; and which of its distinct keys, in order, each of ``keys`` is.

    Keys are spread evenly over 64 bits.
    """
    key, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    sent = _name_form(parts).messages(0, part_in_order(key, parts) // width, [key], times)
    kinds = pa.struct([("part", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])
    if sent is None:
        return pa.array([[]], pa.list_(kinds)), which
    rows = pa.StructArray.from_arrays([sent[f.name] for f in kinds], fields=list(kinds))
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), which


def names(rows: DataFrame, parts: int, width: int, table: str) -> DataFrame:
    """``chunk, part, names``: a number for each distinct key of each chunk, by part (or region) and in order.

    ``rows`` is a table of ``chunk`` and what it asks (:func:`asked`, of as many ``parts``). The same key
    gets the same number everywhere, from 1 on; one that occurs once in all gets 0.
    """
    form = _name_form(parts)

    def answer(t: pa.Table) -> pa.Table:
        release()
        (keys,), many, ends = form.all(t)
        _, which = np.unique(keys, return_inverse=True)
        repeated = np.bincount(which, weights=many) > 1
        part = t["part"][0].as_py()
        number = np.where(repeated, np.cumsum(repeated) * parts - part, 0).astype(np.uint64)[which]
        made = [packed(x) for x in np.split(number, ends[:-1])]
        return pa.table({"chunk": t["chunk"].combine_chunks(), "part": t["part"].combine_chunks(), "names": pa.array(made, pa.binary())})

    sent = rows.select("chunk", F.explode("asked").alias("m")).select("m.part", "chunk", "m.keys", "m.many")
    met = sent if width == 1 else folded(sent, form, width)
    answers = met.groupBy("part").applyInArrow(answer, "chunk long, part int, names binary")
    if width > 1:
        answers = unfolded(sent, answers, form, width, lambda got: gathered(got, "names", "u8"), lambda x: (packed(x),))
    return materialize(answers, table)


def gathered(answers: pa.Table, column: str, kind: str) -> np.ndarray:
    """What all parts have answered one chunk, in the order of its distinct keys."""
    if not answers.num_rows:
        return np.zeros(0, dtype=kind)
    order = np.argsort(answers["part"].to_numpy())
    held = answers[column].to_pylist()
    return np.concatenate([unpacked(held[i], kind) for i in order])
