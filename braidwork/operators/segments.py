"""Signatures along reads, and the runs of k-mers that share one. All of a read's are found in one go over it, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.kmers import clean
from . import bins
from .counting import in_text

#: Windows of a segment at most.
MOST_WINDOWS = 256


def _check(k: int, p: int) -> None:
    if not 5 <= p <= 11 or p > k:
        raise ValueError("p is 5 to 11, and at most k")


def read_signatures(reads: DataFrame, k: int, p: int) -> DataFrame:
    """``read_id, run, pos, signature``: of each window of each run of symbols of a read; ``pos`` is in the read, ``run`` is where the run's windows begin."""
    _check(k, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in W.parts(whole, 1)):
            reads, last, begun = W.Reads(b.column(1)), -2, 0
            for at, code in reads.blocks(k):
                place, signature = W.signatures(code, k, p)
                if not len(place):
                    continue
                place = place + at
                new = np.concatenate([[place[0] != last + 1], place[1:] != place[:-1] + 1])
                first = np.maximum.accumulate(np.where(new, place, begun))
                last, begun = int(place[-1]), int(first[-1])
                read = reads.read_of(place)
                home = reads.starts[read]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(read)), pa.array((first - home).astype(np.int32)), pa.array((place - home).astype(np.int32)), pa.array(signature)], names=["read_id", "run", "pos", "signature"])

    return reads.select("read_id", "seq").mapInArrow(run, "read_id long, run int, pos int, signature long")


def super_kmers(reads: DataFrame, k: int, p: int, capped: bool = True) -> DataFrame:
    """``read_id, start, len, signature``: maximal runs of windows with one signature, cut every 256 windows if ``capped``."""
    _check(k, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in W.parts(whole, 1)):
            reads = W.Reads(b.column(1))
            for found in W.runs(reads, k, p):
                place, n, signature = W.cut(*found, MOST_WINDOWS) if capped else found
                read = reads.read_of(place)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(read)), pa.array((place - reads.starts[read]).astype(np.int32)), pa.array((n + k - 1).astype(np.int32)), pa.array(signature)], names=["read_id", "start", "len", "signature"])

    return reads.select("read_id", "seq").mapInArrow(run, "read_id long, start int, len int, signature long")


def signature_statistics(reads: DataFrame, k: int, p: int) -> DataFrame:
    """``signature, n_kmers`` over all reads, not a sample of them. Each task adds up its own first."""
    _check(k, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4**p + 1, dtype=np.int64)
        for b in (part for whole in batches for part in W.parts(whole)):
            for _, n, signature in W.runs(W.Reads(b.column(0)), k, p):
                np.add.at(total, signature, n)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["signature", "n"])

    return reads.select("seq").mapInArrow(run, "signature long, n long").groupBy("signature").agg(F.sum("n").alias("n_kmers"))


def super_kmer_sequences(reads: DataFrame, k: int, p: int) -> DataFrame:
    """Super-k-mers with their symbols, ready to be dealt out by signature."""
    cut = super_kmers(reads, k, p).join(reads.select("read_id", clean("seq").alias("_whole")), "read_id")
    return cut.select("read_id", "start", "len", "signature", F.substr("_whole", F.col("start") + 1, F.col("len")).alias("seq"))


def count_by_signature(reads: DataFrame, k: int, p: int, both_strands: bool = True) -> DataFrame:
    """The same counts as a plain count, by way of bins of signatures of about equal weight (:mod:`.bins`)."""
    _check(k, p)
    return in_text(bins.counted(reads, k, p, both_strands), k)


def run_statistics(reads: DataFrame, k: int, p: int, ci: int = 2, cx: int = 1_000_000_000, both_strands: bool = True, sample: DataFrame | None = None) -> DataFrame:
    """:func:`.counting.statistics` of a count and of its super-k-mers (``capped``), in one go over the reads: a task deals out a read's runs and numbers them, a bin sends numbers, not k-mers.

    ``sample``: as :func:`.bins.survey` has it.
    """
    _check(k, p)
    made = bins.summed(reads, k, ci, cx, MOST_WINDOWS, both_strands, bins.survey(reads, k, p, sample))
    return made.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in made.columns])
