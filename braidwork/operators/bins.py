"""Counting by bins: runs of neighbouring windows travel together, and each bin is counted apart.

A k-mer and its reverse complement have one signature, so windows dealt out by signature meet. Neighbouring
windows mostly share theirs, and a run of n windows takes n + k - 1 symbols of two bits, not n times k. A survey of a
sample says how much each signature weighs: signatures are put into bins of about equal weight. The windows of one that
is too heavy for a bin are dealt out in runs again, by a wider signature. Only where that is too heavy as well, as in
long repeats, are k-mers counted in the task that finds them and dealt out by their own hash. So what is sent of a
window does not grow with the table, though ever more signatures become too heavy for a bin.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W

#: Symbols of a signature and of a wider one, windows of a bin, about, and windows that are packed at a time.
P, WIDE, BIN_WINDOWS, SENT_WINDOWS = 7, 11, 1_000_000, 1 << 20
#: Windows, packed, whose rows leave a task together: bins and such batches both grow with the table, and rows as their product.
HELD_WINDOWS = 1 << 23
#: A survey reads this share of the reads; where that gives fewer windows than the second number, one block of so many in every task instead.
SHARE, ENOUGH, ONE_IN = 0.01, 100_000, 16
#: A signature heavier than this share of a bin is opened.
HEAVY = 0.5


@dataclass(frozen=True)
class Bins:
    """The bin of each signature, -1 where its windows are dealt out by wider signatures over all ``n``; those of ``opened`` (in order) by their k-mers."""

    of: np.ndarray
    n: int
    p: int
    windows: int = 0  # of all reads, about
    opened: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))

    def wide_of(self, wide: np.ndarray) -> np.ndarray:
        """The bin of each wider signature, -1 where its k-mers are dealt out one by one."""
        to = (((wide * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(self.n)).astype(np.int64)
        if len(self.opened):
            at = np.minimum(np.searchsorted(self.opened, wide), len(self.opened) - 1)
            to[self.opened[at] == wide] = -1
        return to


def _surveyed(reads: DataFrame, k: int, p: int, one_in: int) -> DataFrame:
    """``signature, n`` of the windows of one block in ``one_in``; signature -1 has all symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, symbols, block = np.zeros(4**p + 1, dtype=np.int64), 0, 0
        for b in (part for whole in batches for part in W.parts(whole)):
            r = W.Reads(b.column(0))
            symbols += int(r.sizes.sum())
            for _, code in r.blocks(k, 1 << 14):
                if block % one_in == 0:
                    n += np.bincount(W.signatures(code, k, p)[1], minlength=4**p + 1)
                block += 1
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1).astype(np.int32)), pa.array(np.append(n[held], symbols))], names=["signature", "n"])

    return reads.select("seq").mapInArrow(run, "signature int, n long").groupBy("signature").agg(F.sum("n").alias("n"))


def _heavy(reads: DataFrame, k: int, bins: Bins, one_in: int, over: float) -> np.ndarray:
    """The wider signatures that more than ``over`` windows have, of the windows that go by wider ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            wide, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(wide.view(np.int64)), pa.array(n)], names=["wide", "n"])

        held, many, block = [], 0, 0
        for b in (part for whole in batches for part in W.parts(whole)):
            for _, code in W.Reads(b.column(0)).blocks(k, 1 << 14):
                if block % one_in == 0:
                    at, signature = W.signatures(code, k, bins.p)
                    held.append(W.wide_signatures(code, k, min(WIDE, k))[at[bins.of[signature] < 0]])
                    many += len(held[-1])
                    if many >= SENT_WINDOWS:
                        yield made()
                        held, many = [], 0
                block += 1
        if many:
            yield made()

    found = reads.select("seq").mapInArrow(run, "wide long, n long").groupBy("wide").agg(F.sum("n").alias("n")).where(F.col("n") > over)
    return np.sort(np.array([r.wide for r in found.select("wide").collect()], dtype=np.int64).view(np.uint64))


def survey(reads: DataFrame, k: int, p: int = P, sample: DataFrame | None = None) -> Bins:
    """Bins by a sample; what it misses goes by a hash. The sample decides about balance only, never about counts. 4^p + 1 rows at most reach the driver, and two for each bin.

    ``sample``: about ``SHARE`` of the reads, where they are had for less than by making all.
    """
    few, one_in = reads.sample(SHARE, seed=7) if sample is None else sample, 1
    found = {r.signature: r.n for r in _surveyed(few, k, p, one_in).collect()}
    scale = 1 / SHARE
    if sum(n for s, n in found.items() if s >= 0) < ENOUGH:
        few, one_in = reads, ONE_IN
        found = {r.signature: r.n for r in _surveyed(few, k, p, one_in).collect()}
        scale = max(1.0, (found.get(-1, 0) or 0) / max(1, sum(n for s, n in found.items() if s >= 0)))
    spark = reads.sparkSession
    weights = {s: n * scale for s, n in found.items() if s >= 0}
    total = sum(weights.values())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // BIN_WINDOWS))
    of = ((np.arange(4**p + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
    heavy = HEAVY * total / n
    load = [(sum(w for w in weights.values() if w > heavy) / n, b) for b in range(n)]
    for s, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if w > heavy:
            of[s] = -1
        else:
            least, b = heapq.heappop(load)
            of[s] = b
            heapq.heappush(load, (least + w, b))
    made = Bins(of.astype(np.int32), n, p, int(total))
    return replace(made, opened=_heavy(few, k, made, one_in, heavy / scale)) if (of < 0).any() else made


_SENT = "bin int, sizes binary, runs binary, kmers binary, times binary, reads long, segments long"


def _bound(code: np.ndarray, place: np.ndarray, n: np.ndarray, signature: np.ndarray, k: int, bins: Bins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, windows, bin) of runs; those of heavy signatures are made anew by wider ones. Bin -1: to be opened."""
    to = bins.of[signature].astype(np.int64)
    away = to < 0
    if not away.any():
        return place, n, to
    many = n[away]
    at = np.repeat(place[away], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    wide = W.wide_signatures(code[at[0] : at[-1] + k], k, min(WIDE, k))[at - at[0]]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (wide[1:] != wide[:-1])]))
    return np.concatenate([place[~away], at[first]]), np.concatenate([n[~away], np.diff(np.append(first, len(at)))]), np.concatenate([to[~away], bins.wide_of(wide[first])])


def _packed(code: np.ndarray, place: np.ndarray, n: np.ndarray, to: np.ndarray, k: int, bins: Bins, both: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sizes and symbols of runs, words and times of opened k-mers: each by bin, and where each bin begins (one more: the end)."""
    closed = to >= 0
    order = np.flatnonzero(closed)[np.argsort(to[closed], kind="stable")]
    size = (n + k - 1)[order]
    symbols, held = W.squeezed(code, place[order], size)
    each = np.arange(bins.n + 1)
    ends = np.searchsorted(to[order], each)
    words, times, home = np.zeros((0, len(W.word_sizes(k))), dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not closed.all():
        flat = W.side_by_side(code, place[~closed], n[~closed] + k - 1)
        found = W.sound(flat, k)
        made = W.canonical_words(flat, k)[0] if both else W.forward(flat, k)
        made, times = W.tallied([w[found] for w in made])
        home = (((W.mixed(made) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(bins.n)).astype(np.int64)
        turn = np.argsort(home, kind="stable")
        words, times, home = np.stack(made, axis=1)[turn], times[turn], home[turn]
    begun = np.searchsorted(home, each)
    return [(size.astype(np.uint32), ends), (symbols, np.concatenate([[0], np.cumsum(held)])[ends]), (words, begun), (times, begun)]


def _sent(pieces: list, n: int, reads: int, segments: int) -> pa.RecordBatch:
    """A row for each bin that anything goes to, one at least; the first one has the numbers of reads and segments."""
    full = np.zeros(n, dtype=bool)
    for piece in pieces:
        full |= (np.diff(piece[0][1]) > 0) | (np.diff(piece[2][1]) > 0)
    met = np.flatnonzero(full) if full.any() else np.zeros(1, dtype=np.int64)
    columns = []
    for c in range(4):
        held = [(piece[c][0], piece[c][1].tolist()) for piece in pieces]
        columns.append(pa.array([b"".join([x[at[b] : at[b + 1]].tobytes() for x, at in held]) for b in met.tolist()], pa.binary()))
    once = np.arange(len(met)) == 0
    return pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *columns, pa.array(once * reads), pa.array(once * segments)], names=["bin", "sizes", "runs", "kmers", "times", "reads", "segments"])


def dealt(reads: DataFrame, k: int, bins: Bins, both_strands: bool = True, most: int = 256) -> DataFrame:
    """The runs of all reads, in rows by bin; ``reads`` and ``segments`` (runs of a signature, cut every ``most`` windows) sum up to their numbers."""
    told = reads.sparkSession.sparkContext.broadcast(bins)  # 4^p + 1 numbers, and two for each bin at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = told.value
        pieces, windows, n_reads, segments = [], 0, 0, 0
        for b in (part for whole in batches for part in W.parts(whole)):
            reads, held, many = W.Reads(b.column(0)), [], 0
            n_reads += b.num_rows
            for found in W.runs(reads, k, bins.p):
                segments += int((-(-found[1] // most)).sum())
                held.append(_bound(reads.code, *W.cut(*found, W.BLOCK), k, bins))
                many += int(found[1].sum())
                if many >= SENT_WINDOWS:
                    pieces.append(_packed(reads.code, *(np.concatenate(x) for x in zip(*held)), k, bins, both_strands))
                    windows += many
                    held, many = [], 0
            if held:
                pieces.append(_packed(reads.code, *(np.concatenate(x) for x in zip(*held)), k, bins, both_strands))
                windows += many
            if windows >= HELD_WINDOWS or len(pieces) >= 4 * HELD_WINDOWS // SENT_WINDOWS:
                yield _sent(pieces, bins.n, n_reads, segments)
                pieces, windows, n_reads, segments = [], 0, 0, 0
        if n_reads:
            yield _sent(pieces, bins.n, n_reads, segments)

    return reads.select("seq").mapInArrow(run, _SENT)


def _opened(sizes: np.ndarray, runs: np.ndarray, k: int, both: bool) -> Iterator[list[np.ndarray]]:
    """The k-mers of runs, some runs at a time."""
    held = -(-sizes // 4)
    byte = np.concatenate([[0], np.cumsum(held)])
    step = 0
    while step < len(sizes):
        end = max(step + 1, int(np.searchsorted(byte, byte[step] + W.BLOCK // 4, side="right")) - 1)
        code, n = W.spread(runs[byte[step] : byte[end]]), sizes[step:end] - k + 1
        first = np.repeat(4 * (byte[step:end] - byte[step]), n)
        at = first + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code = np.append(code, np.zeros(k, dtype=np.uint8))
        words = W.canonical_words(code, k)[0] if both else W.forward(code, k)
        yield [w[at] for w in words]
        step = end


def _counted(group: pa.Table, k: int, both: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of every k-mer of a bin, and how often it occurs."""
    of = lambda c, kind: np.frombuffer(b"".join(group[c].to_pylist()), dtype=kind)
    width = len(W.word_sizes(k))
    sizes = of("sizes", np.uint32).astype(np.int64)
    found = list(_opened(sizes, of("runs", np.uint8), k, both)) if len(sizes) else []
    sent, times = of("kmers", np.uint64).reshape(-1, width), of("times", np.int64)
    words = [np.concatenate([*(f[i] for f in found), sent[:, i]]) for i in range(width)]
    del found
    if len(times) or width > 1:
        return _settled(words, np.concatenate([np.ones(len(words[0]) - len(times), dtype=np.int64), times]))
    return W.tallied(words)


def counted(reads: DataFrame, k: int, p: int = P, both_strands: bool = True, bins: Bins | None = None) -> DataFrame:
    """The words of every k-mer and ``cnt``. Each bin is one group of about BIN_WINDOWS windows; no k-mer is in two."""
    names = [f"w{i}" for i in range(len(W.word_sizes(k)))]
    bins = bins or survey(reads, k, p)

    def count(group: pa.Table) -> pa.Table:
        words, n = _counted(group, k, both_strands)
        return pa.table([pa.array(w.view(np.int64)) for w in words] + [pa.array(n)], names=[*names, "cnt"])

    rows = dealt(reads, k, bins, both_strands).repartition(bins.n, "bin")
    return rows.groupBy("bin").applyInArrow(count, ", ".join([*(f"{w} long" for w in names), "cnt long"]))


def summed(reads: DataFrame, k: int, ci: int, cx: int, most: int, both_strands: bool, bins: Bins) -> DataFrame:
    """A row of numbers for each bin, all of which are sums over the bins: of its k-mers, and of the reads and segments that :func:`dealt` tells with it."""
    names = ["n_below_min", "n_above_max", "n_unique", "n_unique_counted", "n_total", "n_reads", "n_super_kmers"]

    def count(group: pa.Table) -> pa.Table:
        _, n = _counted(group, k, both_strands)
        made = [(n < ci).sum(), (n > cx).sum(), len(n), ((n >= ci) & (n <= cx)).sum(), n.sum(), *(np.sum(group[c].to_numpy()) for c in ("reads", "segments"))]
        return pa.table([pa.array([int(x)]) for x in made], names=names)

    rows = dealt(reads, k, bins, both_strands, most).repartition(bins.n, "bin")
    return rows.groupBy("bin").applyInArrow(count, ", ".join(f"{c} long" for c in names))


def _settled(words: list[np.ndarray], times: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each k-mer once, also where the hashes of two meet."""
    key = W.mixed(words)
    order = np.argsort(key)
    key = key[order]
    words, times = [w[order] for w in words], times[order]
    same = key[1:] == key[:-1]
    differs = np.zeros(len(same), dtype=bool)
    for w in words:
        differs |= w[1:] != w[:-1]
    if (same & differs).any():  # k-mers of one hash stand mixed: in order of their words
        turn = np.lexsort(words[::-1])
        words, times = [w[turn] for w in words], times[turn]
        differs = np.zeros(len(same), dtype=bool)
        for w in words:
            differs |= w[1:] != w[:-1]
    first = np.flatnonzero(np.concatenate([[True], differs])) if len(times) else np.zeros(0, dtype=np.int64)
    return [w[first] for w in words], np.add.reduceat(times, first) if len(first) else times
