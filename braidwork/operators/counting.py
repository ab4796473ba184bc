"""K-mers of reads, and their counts. K-mers travel packed, two bits a symbol; text is made last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.kmers import spelled, word_names
from . import bins

K_MAX = 256
#: K-mers of so many symbols are counted where they are found.
SMALL_K = 12
#: Of so few k-mers each task keeps one counter each to its end, and sends each k-mer once.
DENSE_K = 8
#: Windows whose equal k-mers are put together before they leave a task.
TALLY = 1 << 20
#: A task that finds fewer repeats than one in so many windows no longer looks for them; the shuffle's own aggregate does.
WORTH = 10


def _check_k(k: int) -> None:
    if not 1 <= k <= K_MAX:
        raise ValueError(f"k is 1 to {K_MAX}")


def schema_of(k: int, rest: str) -> str:
    return ", ".join([*(f"{w} long" for w in word_names(k)), rest])


def as_batch(words: list[np.ndarray], rest: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [f"w{i}" for i in range(len(words))]
    return pa.RecordBatch.from_arrays([*(pa.array(w.view(np.int64)) for w in words), *rest.values()], names=[*names, *rest])


def tallies(found: Iterator[tuple[list[np.ndarray], np.ndarray | None]], out: str, most: int = TALLY) -> Iterator[pa.RecordBatch]:
    """Batches of k-mers and their weights (None: 1 each), equal ones of about ``most`` windows put together while that pays."""
    held: list[tuple[list[np.ndarray], np.ndarray | None]] = []
    size, worth = 0, True

    def made() -> pa.RecordBatch:
        nonlocal worth
        words = [np.concatenate(w) for w in zip(*(h[0] for h in held))] if len(held) > 1 else held[0][0]
        weight = None if held[0][1] is None else np.concatenate([h[1] for h in held])
        n = len(words[0])
        if worth:
            words, weight = W.tallied(words, weight)
            worth = len(words[0]) < n - n // WORTH
        return as_batch(words, {out: pa.array(np.ones(n, dtype=np.int64) if weight is None else weight)})

    for words, weight in found:
        if not len(words[0]):
            continue
        held.append((words, weight))
        size += len(words[0])
        if size >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def packed_kmers(reads: DataFrame, k: int, both_strands: bool = True, order: str = "ACGT") -> DataFrame:
    """Packed k-mers with ``n``: how many of a task's windows hold it. A k-mer may have several rows; windows over anything else than symbols have none."""
    _check_k(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[list[np.ndarray], None]]:
            for b in (part for whole in batches for part in W.parts(whole)):
                for _, code in W.Reads(b.column(0)).blocks(k):
                    at = W.sound(code, k)
                    words = W.canonical_words(code, k, order)[0] if both_strands else W.forward(code, k)
                    yield [w[at] for w in words], None

        if k > DENSE_K:
            yield from tallies(found(), "n")
            return
        total = np.zeros(4**k, dtype=np.int64)
        for words, _ in found():
            total += np.bincount(words[0].view(np.int64), minlength=4**k)
        held = np.flatnonzero(total)
        yield as_batch([held.astype(np.uint64)], {"n": pa.array(total[held])})

    return reads.select("seq").mapInArrow(run, schema_of(k, "n long"))


def count_packed(reads: DataFrame, k: int, both_strands: bool = True, order: str = "ACGT") -> DataFrame:
    """The words of every k-mer and ``cnt``, before any threshold.

    There are few short k-mers, so each task counts them first and longs are shuffled. Longer ones travel in runs, by bins.
    """
    return count_sized(reads, k, both_strands, order)[0]


def count_sized(reads: DataFrame, k: int, both_strands: bool = True, order: str = "ACGT") -> tuple[DataFrame, int | None]:
    """:func:`count_packed`, and how many k-mers there are at most, about, where that is known without counting."""
    _check_k(k)
    if k > SMALL_K and order == "ACGT":
        plan = bins.survey(reads, k)
        return bins.counted(reads, k, both_strands=both_strands, bins=plan), plan.windows
    made = packed_kmers(reads, k, both_strands, order).groupBy(*word_names(k)).agg(F.sum("n").alias("cnt"))
    return made, 4**k if k <= SMALL_K else None


def in_text(counts: DataFrame, k: int) -> DataFrame:
    """Packed counts as ``kmer, cnt``."""
    return counts.select(spelled(k).alias("kmer"), "cnt")


def count_all(reads: DataFrame, k: int, both_strands: bool = True, order: str = "ACGT") -> DataFrame:
    """``kmer, cnt`` of every k-mer, before any threshold."""
    return in_text(count_packed(reads, k, both_strands, order), k)


def thresholds(counts: DataFrame, ci: int = 1, cx: int | None = None, cs: int | None = None) -> DataFrame:
    """Counts below ``ci`` or above ``cx`` go; what stays is at most ``cs``. The true count is tested."""
    kept = counts.where(F.col("cnt") >= ci) if cx is None else counts.where(F.col("cnt").between(ci, cx))
    return kept if cs is None else kept.withColumn("cnt", F.least("cnt", F.lit(cs).cast("long")))


#: Of each quality symbol the probability that its base is right: a quarter at the least.
_RIGHT = np.array([max(0.25, 1 - 10.0 ** (-(q - 33) / 10.0)) for q in range(128)])


def weighted_packed(reads: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """Packed k-mers and ``cnt`` (double): for each occurrence the probability that all of its bases are right, summed.

    A read whose quality is shorter than itself counts for nothing.
    """
    _check_k(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            for b in (part for whole in batches for part in W.parts(whole)):
                reads = W.Reads(b.column(0))
                quality, ends = W.text_bytes(b.column(1))
                enough = np.diff(ends) >= reads.sizes
                # the quality of each place, in step with the symbols; 1 between reads
                right = np.ones(len(reads.code))
                for_read = np.repeat(np.arange(len(reads.sizes)), reads.sizes * enough)
                step = np.arange(len(for_read)) - np.repeat(np.cumsum(reads.sizes * enough) - reads.sizes * enough, reads.sizes * enough)
                right[reads.starts[for_read] + step] = _RIGHT[np.minimum(quality[ends[for_read] + step], 127)]
                bad = reads.starts[~enough]
                code = reads.code.copy() if len(bad) else reads.code
                for at, size in zip(bad.tolist(), reads.sizes[~enough].tolist()):
                    code[at : at + size] = W.FOREIGN
                for at in range(0, len(code) - k + 1, W.BLOCK):
                    part = code[at : at + W.BLOCK + k - 1]
                    n = len(part) - k + 1
                    product = np.ones(n)
                    for i in range(k):
                        product *= right[at + i : at + i + n]
                    whole = W.sound(part, k)
                    words = W.canonical_words(part, k)[0] if both_strands else W.forward(part, k)
                    yield [w[whole] for w in words], product[whole]

        yield from tallies(found(), "n")

    made = reads.select("seq", "qual").mapInArrow(run, schema_of(k, "n double"))
    return made.groupBy(*word_names(k)).agg(F.sum("n").alias("cnt"))


def count_weighted(reads: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """``kmer, cnt`` of :func:`weighted_packed`."""
    return in_text(weighted_packed(reads, k, both_strands), k)


def statistics(counts: DataFrame, reads: DataFrame, ci: int = 2, cx: int = 1_000_000_000, super_kmers: DataFrame | None = None) -> DataFrame:
    """One row about an unfiltered count: k-mers below ``ci``, above ``cx``, distinct, distinct and kept, all, and reads; and the super-k-mers, if given."""
    one = counts.agg(
        F.count_if(F.col("cnt") < ci).alias("n_below_min"),
        F.count_if(F.col("cnt") > cx).alias("n_above_max"),
        F.count("*").alias("n_unique"),
        F.count_if(F.col("cnt").between(ci, cx)).alias("n_unique_counted"),
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("n_total"),
    )
    one = one.crossJoin(reads.agg(F.count("*").alias("n_reads")))  # one row each
    return one if super_kmers is None else one.crossJoin(super_kmers.agg(F.count("*").alias("n_super_kmers")))
