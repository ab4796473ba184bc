"""Reads seen through a set of k-mers: counters of their windows, and filtering by them.

Long reads are cut into pieces that overlap, and pieces are dealt out to buckets. A bucket asks for each of its distinct
k-mers once, where the set has been dealt to, and gets their counters. It then sums each piece up: its valid windows,
its first bad one, its masked symbols. What pieces say of a read is put together by sums, minima and order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from .sets import KmerSet

#: Symbols of a piece, of all pieces of a bucket, about, and of reads (or k-mers of the set) for each part that the set is dealt to.
PIECE, BUCKET, HOME = 1 << 16, 1_500_000, 3_000_000


def _cut(reads: DataFrame, k: int) -> DataFrame:
    """``read_id, piece, lead, own, text``: pieces of PIECE symbols of their own after ``lead`` symbols of the one before, and with those that their last windows need.

    A window is its first symbol's piece's. Those that begin in ``lead`` may reach into the piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pieces, leads, owns, texts = [], [], [], [], []
            for i, seq in enumerate(b.column(1).to_pylist()):
                seq = seq or ""
                for n, at in enumerate(range(0, max(len(seq), 1), PIECE)):
                    begin = max(0, at - k + 1)
                    ids.append(i)
                    pieces.append(n)
                    leads.append(at - begin)
                    owns.append(min(PIECE, len(seq) - at))
                    texts.append(seq[begin : at + PIECE + k - 1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(pieces, pa.int32()), pa.array(leads, pa.int32()), pa.array(owns, pa.int32()), pa.array(texts, pa.string())], names=["read_id", "piece", "lead", "own", "text"])

    return reads.select("read_id", "seq").mapInArrow(run, "read_id long, piece int, lead int, own int, text string")


def _windows(code: np.ndarray, k: int, both: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where windows of symbols begin, and their k-mers."""
    places, held = [np.zeros(0, dtype=np.int64)], [[np.zeros(0, dtype=np.uint64) for _ in W.word_sizes(k)]]
    for at in range(0, len(code) - k + 1, W.BLOCK):
        part = code[at : at + W.BLOCK + k - 1]
        words = W.canonical_words(part, k)[0] if both else W.forward(part, k)
        sound = W.sound(part, k)
        places.append(at + sound)
        held.append([w[sound] for w in words])
    return np.concatenate(places), [np.concatenate(w) for w in zip(*held)]


def _in_order(words: list[np.ndarray], numbers: bool = True) -> tuple[list[np.ndarray], np.ndarray | None]:
    """Each k-mer once, in the order of its words, in whatever order they come; and (``numbers``) which of those each one is."""
    turn = None
    if len(words) == 1 and not numbers:
        words = [np.sort(words[0])]
    else:
        turn = np.argsort(words[0]) if len(words) == 1 else np.lexsort(words[::-1])
        words = [w[turn] for w in words]
    new = np.ones(len(words[0]), dtype=bool)
    new[1:] = words[0][1:] != words[0][:-1]
    for w in words[1:]:
        new[1:] |= w[1:] != w[:-1]
    which = None
    if numbers:
        which = np.empty(len(new), dtype=np.int64)
        which[turn] = np.cumsum(new) - 1
    return [w[new] for w in words], which


class _Known:
    """K-mers with counters, to look others up in."""

    def __init__(self, words: list[np.ndarray], counts: np.ndarray):
        key = W.mixed(words)
        order = np.argsort(key)
        self.key, self.words, self.counts = key[order], [w[order] for w in words], counts[order]
        same = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        self.most = int(np.diff(np.append(same, len(key))).max(initial=0))  # k-mers that share a hash

    def counts_of(self, words: list[np.ndarray]) -> np.ndarray:
        """The counter of each k-mer; 0 where it is not known."""
        out = np.zeros(len(words[0]), dtype=self.counts.dtype)
        if not len(self.key):
            return out
        first = np.searchsorted(self.key, W.mixed(words))
        for step in range(self.most):
            there = np.minimum(first + step, len(self.key) - 1)
            same = np.ones(len(out), dtype=bool)
            for w, x in zip(words, self.words):
                same &= x[there] == w
            out[same] = self.counts[there[same]]
        return out


_Summary = Callable[[W.Reads, np.ndarray, pa.Table], dict[str, pa.Array]]


def _home(words: list[np.ndarray], homes: int) -> np.ndarray:
    """Where a k-mer of the set is looked up; :func:`_home_column` says the same of columns."""
    return (np.bitwise_xor.reduce(words) % np.uint64(homes)).astype(np.int64)


def _home_column(words: list[str], homes: int) -> Column:
    x = F.col(words[0])
    for w in words[1:]:
        x = x.bitwiseXOR(F.col(w))
    return F.pmod(x, F.lit(homes)).cast("int")


def _put(x: np.ndarray) -> bytes:
    """Numbers by the places of their bytes, as many places as the largest needs, and before them how many."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _got(held: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """The n numbers that :func:`_put` has put at a place, and where they end."""
    width = held[at]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(held, dtype=np.uint8, offset=at + 1, count=width * n).reshape(width, n).T
    return out.view("<u8").reshape(-1), at + 1 + width * n


def _homes(n: int) -> int:
    """The least prime from n: k-mers' numbers have patterns in their bits."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _summed(reads: DataFrame, kmers: KmerSet, summary: _Summary, columns: str, carry: bool = False) -> tuple[DataFrame, bool]:
    """What ``summary`` says of each piece, given its bucket's symbols and the counter at each place; and whether every read is one piece.

    If so, with ``read_id`` or (``carry``) all columns of its read; else with ``read_id, piece``. A bucket's distinct k-mers travel by where they
    are looked up, a row each, in order, as differences; back come their counters alone, in the same order.
    """
    k, both, words = kmers.k, kmers.both_strands, kmers.words
    size = reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("all"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("most")).first()
    held_at_most = kmers.rows.count() if kmers.about is None else kmers.about
    least = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, homes = max(least, -(-size.all // BUCKET)), _homes(max(least, -(-max(size.all, held_at_most) // HOME)))
    whole = size.most <= PIECE
    if whole:
        own = F.coalesce(F.length("seq"), F.lit(0))
        dealt = reads.select(F.struct(*(reads.columns if carry else ["read_id", "seq"])).alias("row"), F.lit(0).alias("piece"), F.lit(0).alias("lead"), own.alias("own"), F.pmod(F.xxhash64("read_id", F.lit(0)), F.lit(buckets)).cast("int").alias("bucket"))
    else:
        dealt = _cut(reads, k).withColumn("bucket", F.pmod(F.xxhash64("read_id", "piece"), F.lit(buckets)).cast("int"))

    def texts(group: pa.Table) -> pa.Array:
        if not group.num_rows:
            return pa.array([], pa.string())
        return pc.struct_field(group["row"].combine_chunks(), "seq") if whole else group["text"].combine_chunks()

    def at_home(wanted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The places of a bucket's k-mers by home, and where each home's begin."""
        home = _home(wanted, homes)
        turn = np.argsort(home.astype(np.uint16) if homes < 1 << 16 else home, kind="stable")
        return turn, np.searchsorted(home[turn], np.arange(homes + 1))

    def ask(group: pa.Table) -> pa.Table:
        wanted = _in_order(_windows(W.Reads(texts(group)).code, k, both)[1], False)[0]
        turn, ends = at_home(wanted)
        met = np.flatnonzero(np.diff(ends))
        first = wanted[0][turn]
        sent = [_put(np.diff(first[ends[h] : ends[h + 1]], prepend=np.uint64(0))) + b"".join(_put(w[turn[ends[h] : ends[h + 1]]]) for w in wanted[1:]) for h in met.tolist()]
        bucket = pa.array(np.full(len(met), group["bucket"][0].as_py(), dtype=np.int32))
        return pa.table({"home": pa.array(met.astype(np.int32)), "bucket": bucket, "n": pa.array(np.diff(ends)[met].astype(np.int32)), "kmers": pa.array(sent, pa.binary())})

    kind = np.float64 if kmers.weighted else np.int64

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"home": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
        known = _Known([held[w].to_numpy().view(np.uint64) for w in words], held["cnt"].to_numpy())
        told = []
        for n, sent in zip(asked["n"].to_pylist(), asked["kmers"]):
            sent, at, of = sent.as_py(), 0, []
            for i in range(len(words)):
                x, at = _got(sent, at, n)
                of.append(x if i else np.cumsum(x, dtype=np.uint64))
            told.append(_put(known.counts_of(of).view(np.uint64)))
        return pa.table({"home": asked["home"], "bucket": asked["bucket"], "counts": pa.array(told, pa.binary())})

    asked = dealt.groupBy("bucket").applyInArrow(ask, "home int, bucket int, n int, kmers binary")
    held = kmers.rows.select(_home_column(words, homes).alias("home"), *words, F.col("cnt").cast("double" if kmers.weighted else "long").alias("cnt"))
    answers = asked.groupBy("home").cogroup(held.groupBy("home")).applyInArrow(answer, "home int, bucket int, counts binary")

    def tell(group: pa.Table, told: pa.Table) -> pa.Table:
        r = W.Reads(texts(group))
        places, found = _windows(r.code, k, both)
        wanted, which = _in_order(found)
        turn, ends = at_home(wanted)
        counts = np.zeros(len(turn), dtype=kind)
        for h, sent in zip(told["home"].to_pylist(), told["counts"]):
            counts[turn[ends[h] : ends[h + 1]]] = _got(sent.as_py(), 0, int(ends[h + 1] - ends[h]))[0].view(kind)
        at = np.zeros(max(0, len(r.code) - k + 1), dtype=kind)
        at[places] = counts[which]
        made = summary(r, at, group)
        if not whole:
            return pa.table({"read_id": group["read_id"], "piece": group["piece"], **made})
        return pa.table({"row": group["row"] if carry else pc.struct_field(group["row"].combine_chunks(), "read_id"), **made})

    row = reads.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString() if carry else "long"
    made = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(tell, f"row {row}, {columns}" if whole else f"read_id long, piece int, {columns}")
    if whole:
        made = made.select("row.*" if carry else F.col("row").alias("read_id"), *[c.split()[0] for c in columns.split(", ")])
    return made, whole


def _own_windows(r: W.Reads, k: int, group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, pos in its read, place) of the windows that begin in each piece's own symbols."""
    lead, own = group["lead"].to_numpy().astype(np.int64), group["own"].to_numpy().astype(np.int64)
    n = np.maximum(np.minimum(own, r.sizes - lead - k + 1), 0)
    piece = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return piece, group["piece"].to_numpy().astype(np.int64)[piece] * PIECE + step, r.starts[piece] + lead[piece] + step


def counters(reads: DataFrame, kmers: KmerSet) -> DataFrame:
    """``read_id, counters``: the counter of each window in order; 0 where it is no k-mer or the set has it not.

    A read shorter than k has none. Windows are looked up in canonical form if the set has both strands.
    """
    k = kmers.k

    def summary(r: W.Reads, at: np.ndarray, group: pa.Table) -> dict[str, pa.Array]:
        piece, _, place = _own_windows(r, k, group)
        ends = np.concatenate([[0], np.cumsum(np.bincount(piece, minlength=group.num_rows))]).astype(np.int32)
        return {"counters": pa.ListArray.from_arrays(ends, pa.array(at[place]))}

    made, whole = _summed(reads, kmers, summary, f"counters array<{'double' if kmers.weighted else 'long'}>")
    if whole:
        return made.select("read_id", "counters")
    parts = F.array_sort(F.collect_list(F.struct("piece", "counters")))
    return made.groupBy("read_id").agg(F.flatten(F.transform(parts, lambda x: x["counters"])).alias("counters"))


def valid_windows(reads: DataFrame, kmers: KmerSet) -> DataFrame:
    """``read_id, n_valid``: windows whose k-mer the set has."""
    return _valid(reads, kmers, False)[0]


def _valid(reads: DataFrame, kmers: KmerSet, carry: bool) -> tuple[DataFrame, bool]:
    """Valid windows by read; and whether every read is one piece, which then (``carry``) has its columns with it."""
    k = kmers.k

    def summary(r: W.Reads, at: np.ndarray, group: pa.Table) -> dict[str, pa.Array]:
        piece, _, place = _own_windows(r, k, group)
        return {"n_valid": pa.array(np.bincount(piece[at[place] > 0], minlength=group.num_rows).astype(np.int64))}

    made, whole = _summed(reads, kmers, summary, "n_valid long", carry)
    return (made if whole else made.groupBy("read_id").agg(F.sum("n_valid").alias("n_valid"))), whole


def filter_reads(reads: DataFrame, kmers: KmerSet, least: float = 2, most: float = 1_000_000_000) -> DataFrame:
    """Reads with ``least`` to ``most`` windows whose k-mer is in the set; fractions are of all its windows, cut to a whole number."""
    windows = F.greatest(F.length("seq") - kmers.k + 1, F.lit(0))
    limit = lambda x: F.lit(x) if isinstance(x, int) else F.floor(windows * F.lit(x)).cast("long")
    made, whole = _valid(reads, kmers, True)
    seen = made if whole else reads.join(made, "read_id")
    return seen.where((F.col("n_valid") >= limit(least)) & (F.col("n_valid") <= limit(most))).drop("n_valid")


def trim_reads(reads: DataFrame, kmers: KmerSet, least: int = 2) -> DataFrame:
    """Reads up to before the last symbol of their first window below ``least``; those that begin with one, or are shorter than k, go."""
    k = kmers.k

    def summary(r: W.Reads, at: np.ndarray, group: pa.Table) -> dict[str, pa.Array]:
        piece, pos, place = _own_windows(r, k, group)
        bad = np.flatnonzero(at[place] < least)
        which, first = np.unique(piece[bad], return_index=True)
        out = np.full(group.num_rows, -1, dtype=np.int64)
        out[which] = pos[bad[first]]
        return {"_bad": pa.array(out, mask=out < 0)}

    made, whole = _summed(reads, kmers, summary, "_bad long", True)
    seen = made if whole else reads.join(made.groupBy("read_id").agg(F.min("_bad").alias("_bad")), "read_id")
    length = F.when(F.col("_bad").isNull(), F.length("seq")).otherwise(kmers.k + F.col("_bad") - 1)
    kept = seen.where(F.length("seq") >= kmers.k).where("_bad IS NULL OR _bad > 0")
    cut = lambda c: F.substr(c, F.lit(1), length.cast("int")).alias(c)
    return kept.select(*[cut(c) if c in ("seq", "qual") else c for c in reads.columns])


def mask_reads(reads: DataFrame, kmers: KmerSet, least: int = 2) -> DataFrame:
    """All reads, with N for each symbol that a window below ``least`` covers."""
    k = kmers.k

    def summary(r: W.Reads, at: np.ndarray, group: pa.Table) -> dict[str, pa.Array]:
        # windows of all pieces, those that begin in what leads too
        inside = np.zeros(len(r.code) + 1, dtype=bool)
        n = np.maximum(r.sizes - k + 1, 0)
        inside[np.repeat(r.starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = True
        bad = np.flatnonzero(inside[: len(at)] & (at < least))
        cover = np.zeros(len(r.code) + 1, dtype=np.int64)
        cover[bad] += 1
        np.subtract.at(cover, bad + k, 1)
        covered = np.cumsum(cover) > 0
        out = []
        for text, start, lead, own in zip((pc.struct_field(group["row"].combine_chunks(), "seq") if "row" in group.column_names else group["text"]).to_pylist(), r.starts.tolist(), group["lead"].to_pylist(), group["own"].to_pylist()):
            hit, part = covered[start + lead : start + lead + own], text and text[lead : lead + own]
            if hit.any():
                if part.isascii():
                    symbols = np.frombuffer(part.encode(), dtype=np.uint8).copy()
                    symbols[hit] = ord("N")
                    part = symbols.tobytes().decode()
                else:
                    part = "".join("N" if h else c for c, h in zip(part, hit))
            out.append(part)
        return {"_masked": pa.array(out, pa.string())}

    made, whole = _summed(reads, kmers, summary, "_masked string", True)
    if not whole:
        parts = F.array_sort(F.collect_list(F.struct("piece", "_masked")))
        made = reads.join(made.groupBy("read_id").agg(F.array_join(F.transform(parts, lambda x: x["_masked"]), "").alias("_masked")), "read_id")
    return made.select(*[F.when(F.col("seq").isNotNull(), F.col("_masked")).alias("seq") if c == "seq" else c for c in reads.columns])


def check_mode(mode: str, least: float, most: float) -> None:
    """Fractions are for the normal mode alone."""
    if mode != "normal" and not (isinstance(least, int) and isinstance(most, int)):
        raise ValueError("fractions go with the normal mode only")


def filtered(reads: DataFrame, kmers: KmerSet, mode: str = "normal", least: float = 2, most: float = 1_000_000_000) -> DataFrame:
    """One of the modes normal, trim and mask."""
    check_mode(mode, least, most)
    modes = {"normal": lambda: filter_reads(reads, kmers, least, most), "trim": lambda: trim_reads(reads, kmers, int(least)), "mask": lambda: mask_reads(reads, kmers, int(least))}
    if mode not in modes:
        raise ValueError(f"a mode is one of {', '.join(modes)}")
    return modes[mode]()
