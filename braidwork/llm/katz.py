"""Scores of texts under a Katz backoff n-gram model with Good-Turing discounts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as texts_of
from .common import discard, materialize, release
from .exchange import Form, folded, gathered, packed, part_of, parts_for, rising, risen, unfolded, unpacked, width_for

#: Words of the longest n-grams that are counted.
ORDER = 3
#: Tokens that a partition of the n-gram table holds, about; n-grams after a word more frequent than that are spread over several.
PARTITION_TOKENS, LEAST_PARTS = 1_000_000, 64
#: N-grams that are sorted or worked on at a time, about: what a task holds beside a partition's own numbers does not grow with the partition.
RUN_GRAMS = 1 << 17
#: Counts above this are not discounted.
K = 5
#: Stands for the end of a text in the vocabulary: no word hashes to it, and to a second half of zero, but by a 2^-128 chance.
END = np.uint64(0xE0D0E0D0E0D0E0D0)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


# Texts as numbers


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): where each distinct pair of halves is found, in order, and which one each pair is. Words mostly differ in the first half already."""
    _, first, which = np.unique(a, return_index=True, return_inverse=True)
    if (b[first][which] == b).all():
        return first, which
    order = np.lexsort((b, a))
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    which = np.empty(len(a), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _dealt(a: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, order, back) of a vocabulary in order: by part and then as it is; ``back`` leads from its order to that."""
    part = part_of(a, parts)
    order = np.argsort(part, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return part[order], order, back


def local_tokens(documents: DataFrame, trains: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a chunk of documents: tokens by their place in the chunk's own vocabulary, and the counts of its training tokens."""

    most = texts_of.CHUNK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words, ends in texts_of.chunks(batches, 1, lower=True, most=most, wide=True):
            size = np.diff(ends)
            stops = np.cumsum(size + 1)  # with one end a text
            tokens = np.zeros((int(stops[-1]), 2), dtype=np.uint64)
            tokens[stops - 1, 0] = END
            inner = np.ones(len(tokens), dtype=bool)
            inner[stops - 1] = False
            tokens[inner] = words
            train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            first, ids = _numbered(tokens[:, 0], tokens[:, 1])
            vocabulary, second = tokens[first, 0], tokens[first, 1]
            counts = np.bincount(ids, weights=np.repeat(train, size + 1), minlength=len(vocabulary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([packed(ids.astype(np.uint32))], pa.binary()), pa.array([packed(size.astype(np.uint32) + 1)], pa.binary()), pa.array([packed(train)], pa.binary()),
                pa.array([b.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([packed(vocabulary)], pa.binary()), pa.array([second.tobytes()], pa.binary()), pa.array([packed(counts.astype(np.uint32))], pa.binary()), pa.array([len(tokens)]), pa.array([len(vocabulary)]),
            ], names=["tokens", "sizes", "train", "keys", "vocabulary", "second", "counts", "n", "types"])
        release()

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(trains, F.lit(False)).alias("train"))
    made = rows.mapInArrow(run, f"tokens binary, sizes binary, train binary, keys array<{kind}>, vocabulary binary, second binary, counts binary, n long, types long")
    return materialize(made.withColumn("chunk", F.monotonically_increasing_id()), "katz-local", large=True)


@dataclass
class Words:
    """The unigram model. Ids go from the most frequent training token down, so an id tells its count.

    ``counts`` and ``first`` have one entry for each count that occurs (at most the square root of
    twice the tokens): the count, falling, and the first id that has it. ``types`` is the id of all
    tokens that training has not seen, and types + 1 stands for the beginning of a text. A word of
    ``spread`` tokens or more has its n-grams in several partitions.
    """

    counts: np.ndarray
    first: np.ndarray
    types: int
    tokens: int
    texts: int
    spread: int = PARTITION_TOKENS
    discount: np.ndarray = field(init=False)
    unknown: float = field(init=False)

    def __post_init__(self) -> None:
        of = dict(zip(self.counts.tolist(), np.diff(np.append(self.first, self.types)).tolist()))
        self.discount = good_turing(np.array([of.get(r, 0) for r in range(1, K + 2)], dtype=np.float64))
        freed = sum((1 - self.discount[r]) * r * of.get(r, 0) for r in range(1, K + 1)) / max(self.tokens, 1)
        self.unknown = max(freed, 1 / (self.tokens + 1)) if self.tokens else 1.0
        held = sum((self.discount[r] if r <= K else 1.0) * r * n for r, n in of.items())
        self.scale = (1 - self.unknown) / held if held else 0.0

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training count of each id; of the beginning: the training texts."""
        c = np.append(self.counts, 0)[np.searchsorted(self.first, np.minimum(ids, self.types), side="right") - 1] if len(self.first) else np.zeros(len(ids), dtype=np.int64)
        return np.where(ids < self.types, c, np.where(ids == self.types, 0, self.texts))

    def probability(self, ids: np.ndarray) -> np.ndarray:
        """Sums to 1 over all training types and one for all others."""
        c = self.count(ids)
        return np.where(ids < self.types, self.scale * c * self.discount[np.minimum(c, K + 1)], self.unknown)


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discounts by count, 0 to K + 1 and beyond, from the numbers of types seen 1 to K + 1 times.

    Katz's form: what they free is what Good and Turing give to the unseen. Counts for which it is not
    defined, or not between 0 and 1, keep 0.99 of theirs, so that something is always freed.
    """
    d = np.ones(K + 2)
    top = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        star = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 0.0
        x = (star - top) / (1 - top) if top < 1 else 0.0
        d[r] = x if 0.01 < x < 0.99 else 0.99
    return d


def encode(local: DataFrame) -> tuple[DataFrame, Words]:
    """Chunks with their tokens as ranks in the chunk's own sorted ids of the vocabulary; and the vocabulary's counts.

    A chunk's distinct words meet those of all others in one exchange. Types of one count get ids by
    partition and then by hash; where those of a count begin in each partition is a running sum over
    the partitions.
    """
    total = local.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    parts = parts_for(total)
    width = width_for(parts)
    form = Form(
        ["keys", "seconds", "c"],
        lambda keys, seconds, c: ([risen(keys), np.frombuffer(seconds, dtype=np.uint64)], unpacked(c, "u4")),
        lambda columns, c: (rising(columns[0]), columns[1].tobytes(), packed(c.astype(np.uint32))),
        lambda columns: _numbered(*columns),
        lambda columns: part_of(columns[0], parts),
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a, c = unpacked(b["vocabulary"][i].as_py(), "u8"), unpacked(b["counts"][i].as_py(), "u4")
                part, order, _ = _dealt(a, parts)
                yield form.messages(b["chunk"][i].as_py(), part // width, [a[order], np.frombuffer(b["second"][i].as_py(), dtype=np.uint64)[order]], c[order])
        release()

    def merge(t: pa.Table) -> pa.Table:
        release()
        (a, second), c, sizes = form.all(t)
        first, which = _numbered(a, second)
        count = np.bincount(which, weights=c).astype(np.int64)
        value, n = np.unique(count, return_counts=True)
        ends = int(count[(a[first] == END) & (second[first] == 0)].sum())
        asked = [packed(x.astype(np.uint32)) for x in np.split(which, sizes[:-1])]
        return pa.table({"part": t["part"][:1], "chunks": pa.array([t["chunk"].to_pylist()], pa.list_(pa.int64())), "asked": pa.array([asked], pa.list_(pa.binary())), "counts": pa.array([packed(count)], pa.binary()), "value": pa.array([value.tolist()], pa.list_(pa.int64())), "types": pa.array([n.tolist()], pa.list_(pa.int64())), "ends": pa.array([ends])})

    asked = local.select("chunk", "vocabulary", "second", "counts").mapInArrow(ask, form.schema)
    if width > 1:
        asked = materialize(asked, "katz-asked-words", large=True)
    table = (asked if width == 1 else folded(asked, form, width)).groupBy("part").applyInArrow(merge, "part int, chunks array<long>, asked array<binary>, counts binary, value array<long>, types array<long>, ends long")
    table = materialize(table, "katz-types", large=True)
    per = table.select("part", F.inline(F.arrays_zip("value", "types"))).where("value > 0")
    of = sorted(((r.value, r.n) for r in per.groupBy("value").agg(F.sum("types").alias("n")).collect()), reverse=True)  # at most sqrt(2 tokens) rows
    counts, sizes = np.array([c for c, _ in of], dtype=np.int64), np.array([n for _, n in of], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    words = Words(counts, first, int(sizes.sum()), int((counts * sizes).sum()), table.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0], PARTITION_TOKENS)
    before = F.sum("types").over(Window.partitionBy("value").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("value", "before"))).alias("before"))
    told = local.sparkSession.sparkContext.broadcast(words)  # sqrt(2 tokens) numbers

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = told.value
        start = dict(zip(w.counts.tolist(), w.first.tolist()))
        for b in batches:
            for i in range(b.num_rows):
                count, begun = unpacked(b["counts"][i].as_py(), "i8"), dict(b["before"][i].as_py() or [])
                value, which, n = np.unique(count, return_inverse=True, return_counts=True)
                order = np.argsort(which, kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
                base = np.array([start[c] + begun[c] if c else 0 for c in value.tolist()], dtype=np.int64)
                ids = np.where(count > 0, base[which] + rank, w.types).astype(np.uint64)
                for chunk, want in zip(b["chunks"][i].as_py(), b["asked"][i].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), b["part"].slice(i, 1), pa.array([packed(ids[unpacked(want, "u4")])], pa.binary())], names=["chunk", "part", "ids"])

    answers = table.join(starts, "part", "left").select("part", "chunks", "asked", "counts", "before").mapInArrow(answer, "chunk long, part int, ids binary")
    if width > 1:
        answers = unfolded(asked, answers, form, width, lambda got: gathered(got, "ids", "u8"), lambda x: (packed(x),))
    answers = materialize(answers, "katz-ids", large=True)
    discard(table)
    if width > 1:
        discard(asked)
    kind = local.schema["keys"].dataType.simpleString()

    def finish(chunk: pa.Table, got: pa.Table) -> pa.Table:
        _, _, which = _dealt(unpacked(chunk["vocabulary"][0].as_py(), "u8"), parts)
        ids, rank = np.unique(gathered(got, "ids", "u8")[which], return_inverse=True)
        tokens = rank.astype(np.uint32)[unpacked(chunk["tokens"][0].as_py(), "u4")]
        return pa.table({"chunk": chunk["chunk"], "tokens": pa.array([packed(tokens)], pa.binary()), "ids": pa.array([rising(ids)], pa.binary()), "sizes": chunk["sizes"], "train": chunk["train"], "keys": chunk["keys"]})

    rows = local.select("chunk", "tokens", "vocabulary", "sizes", "train", "keys")
    encoded = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"chunk long, tokens binary, ids binary, sizes binary, train binary, keys {kind}")
    encoded = materialize(encoded, "katz-tokens", large=True)
    discard(answers)
    return encoded, words


# N-grams


@dataclass
class Grams:
    """A chunk's distinct n-grams, by partition and then in order: ``columns`` are the last word of the context, the one before it, and so on, and then the token. ``which`` tells each token's, or -1 after an unknown word, when nothing longer than a word has a count."""

    part: np.ndarray
    columns: list[np.ndarray]
    which: np.ndarray


def salts(words: Words, last: np.ndarray) -> np.ndarray:
    """Over how many partitions the n-grams are spread, by token, whose context ends in each word."""
    return 1 + words.count(last) // words.spread


def _part(columns: list[np.ndarray], words: Words, parts: int) -> np.ndarray:
    """Where n-grams are: with all others whose contexts end in the same word, or if that word is frequent, spread by token."""
    last, token = columns[0], columns[-1]
    spread = ((token.astype(np.uint64) * _SPREAD) >> np.uint64(33)).astype(np.int64) % salts(words, last)
    return part_of((last.astype(np.uint64) << np.uint64(20)) + spread.astype(np.uint64), parts)


def grams(tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray, words: Words, order: int, parts: int) -> Grams:
    ids = np.append(ids.astype(np.int64), words.types + 1)
    begin, n, v = len(ids) - 1, len(tokens), len(ids)
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns = []
    for back in range(1, order):
        c = np.full(n, begin, dtype=np.int64)
        c[back:] = np.where(place[back:] >= back, tokens[:-back], begin)
        columns.append(c)
    columns.append(tokens.astype(np.int64))
    key, span = np.zeros(n, dtype=np.int64), 1
    for c in columns:  # ranks order as ids do
        if span * v >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            span = int(key.max(initial=0)) + 1
        key, span = key * v + c, span * v
    asks = ids[columns[0]] != words.types
    _, first, inverse = np.unique(key[asks], return_index=True, return_inverse=True)
    first = np.flatnonzero(asks)[first]
    columns = [ids[c[first]] for c in columns]
    part = _part(columns, words, parts)
    by_part = np.argsort(part.astype(np.int32), kind="stable")
    back = np.empty_like(by_part)
    back[by_part] = np.arange(len(by_part))
    which = np.full(n, -1)
    which[asks] = back[inverse]
    return Grams(part[by_part], [c[by_part] for c in columns], which)


def _chunk(b: pa.RecordBatch | pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return unpacked(b["tokens"][i].as_py(), "u4").astype(np.int64), risen(b["ids"][i].as_py()), unpacked(b["sizes"][i].as_py(), "u4").astype(np.int64), unpacked(b["train"][i].as_py(), "?")


def _pieces(columns: list[np.ndarray], at: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Rows (``at``: of these) in pieces of about RUN_GRAMS, in the columns' order; equal rows are in one piece. A value that would fill a piece is cut by the next column."""
    if not columns:
        yield at
        return
    c = columns[0] if at is None else columns[0][at]
    if len(c) <= 2 * RUN_GRAMS:
        yield np.arange(len(c)) if at is None else at
        return
    begins = np.sort(c)[::RUN_GRAMS]
    heavy = np.unique(begins[1:][begins[1:] == begins[:-1]])
    begins = np.unique(np.concatenate([begins, heavy + 1]))
    for i, alone in enumerate(np.isin(begins, heavy)):
        inside = c >= begins[i]
        if i + 1 < len(begins):
            inside &= c < begins[i + 1]
        piece = np.flatnonzero(inside) if at is None else at[inside]
        del inside
        if alone:
            yield from _pieces(columns[1:], piece)
        elif len(piece):
            yield piece


def _sorted_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): where each distinct row of the columns is found, in order, and which one each row is."""
    found, which, n = [np.zeros(0, dtype=np.int64)], np.empty(len(columns[0]), dtype=np.int64), 0
    for at in _pieces(columns):
        first, inside = _sorted_piece([c[at] for c in columns])
        which[at] = inside + n
        found.append(at[first])
        n += len(first)
    return np.concatenate(found), which


def _sorted_piece(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, span = np.zeros(len(columns[0]), dtype=np.int64), 1
    for c in columns:
        width = int(c.max(initial=0)) + 1
        if span * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            span = int(key.max(initial=0)) + 1
        if span * width >= 1 << 62:
            c = np.unique(c, return_inverse=True)[1]
            width = int(c.max(initial=0)) + 1
        key, span = key * width + c, span * width
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return first, which


def _runs(last: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of n-grams in order: about RUN_GRAMS, or all whose contexts end in one word. The tables of runs need nothing of each other."""
    at = 0
    while at < len(last):
        word = last[min(at + RUN_GRAMS, len(last)) - 1]
        begin, end = int(np.searchsorted(last, word)), int(np.searchsorted(last, word, side="right"))
        end = end if end <= at + RUN_GRAMS or begin == at else begin
        yield at, end
        at = end


@dataclass
class Table:
    """A run of n-grams of all orders down to pairs, from its longest ones; the first entries are of ``order``.

    For each order: ``context`` numbers the contexts in order, ``r`` are counts in training, ``lower``
    leads to the n-gram without its first word, and for pairs to ``token``. ``names`` are the contexts'
    words, the last one first.
    """

    context: list[np.ndarray]
    r: list[np.ndarray]
    lower: list[np.ndarray]
    names: list[list[np.ndarray]]
    token: np.ndarray

    @staticmethod
    def of(columns: list[np.ndarray], r: np.ndarray) -> Table:
        made = Table([], [], [], [], columns[-1])
        for order in range(len(columns), 1, -1):
            before = columns[:-1]
            new = np.ones(len(r), dtype=bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in before], axis=0)
            made.context.append(np.cumsum(new) - 1)
            made.r.append(r)
            made.names.append([c[new] for c in before])
            if order == 2:
                made.lower.append(np.arange(len(r)))
                made.token = columns[-1]
                break
            columns = [*columns[: order - 2], columns[-1]]
            first, which = _sorted_rows(columns)
            made.lower.append(which)
            r = np.bincount(which, weights=r, minlength=len(first)).astype(np.int64)
            columns = [c[first] for c in columns]
        return made

    def counts_of_counts(self) -> list[list[int]]:
        return [np.bincount(np.minimum(r, K + 2), minlength=K + 3)[1 : K + 2].tolist() for r in self.r]

    def sums(self, level: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each context: its tokens, how many of its n-grams have each count up to K, and the probability that the next lower order gives to what it has seen."""
        context, r = self.context[level], self.r[level]
        many = len(self.names[level][0])
        n = np.empty((many, K))
        for c in range(K):
            n[:, c] = np.bincount(context[r == c + 1], minlength=many)
        return np.bincount(context, weights=r, minlength=many), n, np.bincount(context, weights=np.where(r > 0, p, 0.0), minlength=many)


def probabilities(t: Table, words: Words, discounts: list[np.ndarray], known: Known, until: int = 0) -> np.ndarray:
    """Of the n-grams of the order at ``until`` (0: the longest): the discounted share of those seen in training, and else the context's weight times what the next lower order gives.

    A context's weight is what its discounts have freed over what the lower order gives to all that it has not
    seen, so that its probabilities sum to 1. ``known`` has the sums of contexts that are spread over several partitions.
    """
    p = words.probability(t.token)
    for level in range(len(t.r) - 1, until - 1, -1):
        p = p[t.lower[level]]
        total, n, held = t.sums(level, p)
        names = t.names[level]
        if len(names) in known:
            at, sums = _spread_sums(names, np.flatnonzero(salts(words, names[0]) > 1), *known[len(names)])
            total[at], n[at], held[at] = sums[:, 0], sums[:, 1:-1], sums[:, -1]
        d = discounts[level]
        low = n @ np.arange(1, K + 1)
        kept = (n @ (d[1 : K + 1] * np.arange(1, K + 1)) + (total - low)) / np.maximum(total, 1)
        plain = low == 0  # nothing to discount: as if seen once more, with a token of any kind
        kept = np.where(plain, total / (total + 1), kept)
        shrink = np.where(plain, total / (total + 1), 1.0) / np.maximum(total, 1)
        weight = np.where(total > 0, (1 - kept) / np.maximum(1 - held, 1e-300), 1.0)
        context, r = t.context[level], t.r[level]
        p = np.where(r > 0, d[np.minimum(r, K + 1)] * r * shrink[context], weight[context] * p)
    return p


def log_probabilities(columns: list[np.ndarray], r: np.ndarray, words: Words, discounts: list[np.ndarray], known: Known) -> np.ndarray:
    """Of a partition's longest n-grams, run by run."""
    log = np.empty(len(r))
    for lo, hi in _runs(columns[0]):
        log[lo:hi] = np.log10(np.maximum(probabilities(Table.of([c[lo:hi] for c in columns], r[lo:hi]), words, discounts, known), 1e-300))
    return log


def _id_kind(words: Words) -> type:
    """What holds all ids, and one more than the beginning's."""
    return np.uint32 if words.types + 2 < 1 << 32 else np.int64


def _table(b: pa.RecordBatch | pa.Table, i: int, order: int, words: Words) -> tuple[list[np.ndarray], np.ndarray]:
    """A partition's n-grams of the longest order, and their counts in training."""
    kind = _id_kind(words)
    return [(unpacked(b[f"c{j}"][i].as_py(), "u8") if j else risen(b["c0"][i].as_py())).astype(kind) for j in range(order)], unpacked(b["r"][i].as_py(), "i8")


def _gram_form(told: Broadcast, order: int, parts: int) -> Form:
    """N-grams with their counts in training; ``told`` has the unigram model."""
    kind = _id_kind(told.value)
    return Form(
        [*[f"c{i}" for i in range(order)], "r"],
        lambda c, *rest: ([risen(c).astype(kind), *[unpacked(x, "u8").astype(kind) for x in rest[:-1]]], unpacked(rest[-1], "u4")),
        lambda columns, r: (*[packed(c.astype(np.uint64)) if j else rising(c) for j, c in enumerate(columns)], packed(r.astype(np.uint32))),
        _sorted_rows,
        lambda columns: _part(columns, told.value, parts),
    )


def fit(encoded: DataFrame, words: Words, order: int, total: int) -> tuple[DataFrame, list[np.ndarray], tuple[DataFrame, Form] | None]:
    """The table of n-grams, one row a partition, with what each chunk (or block) has asked it; the discounts of each order; and where chunks have asked regions, what they have asked.

    All n-grams whose contexts end in one word are in one partition, so that each order is there
    with all lower ones down to pairs, and what they come down to are single words, whose ids tell
    their probability. A word that would fill a partition has its n-grams spread by token.
    """
    parts = max(LEAST_PARTS, -(-total // PARTITION_TOKENS))
    told = encoded.sparkSession.sparkContext.broadcast(words)
    names = [f"c{i}" for i in range(order)]
    form, width = _gram_form(told, order, parts), width_for(parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tokens, ids, sizes, train = _chunk(b, i)
                g = grams(tokens, ids, sizes, told.value, order, parts)
                asks = g.which >= 0
                r = np.bincount(g.which[asks], weights=np.repeat(train, sizes)[asks], minlength=len(g.part))
                if (sent := form.messages(b["chunk"][i].as_py(), g.part // width, g.columns, r)) is not None:
                    yield sent
                del tokens, ids, sizes, train, g, asks, r, sent
        release()

    def merge(t: pa.Table) -> pa.Table:
        release()
        columns, r, ends = form.all(t)
        first, which = _sorted_rows(columns)
        columns = [c[first] for c in columns]
        count = np.bincount(which, weights=r, minlength=len(first)).astype(np.int64)
        del first, r
        asked = [rising(x) for x in np.split(which, ends[:-1])]
        del which
        of = sum(np.array(Table.of([c[lo:hi] for c in columns], count[lo:hi]).counts_of_counts()) for lo, hi in _runs(columns[0])).tolist()
        made = {"part": t["part"][:1], "chunks": pa.array([t["chunk"].to_pylist()], pa.list_(pa.int64())), "asked": pa.array([asked], pa.list_(pa.binary()))}
        made |= {c: pa.array([packed(x.astype(np.uint64)) if j else rising(x)], pa.binary()) for j, (c, x) in enumerate(zip(names, columns))}
        return pa.table(made | {"r": pa.array([packed(count)], pa.binary()), "of": pa.array([of], pa.list_(pa.list_(pa.int64()))), "hot": pa.array([bool((salts(told.value, np.unique(columns[0])) > 1).any())])})

    binary = ", ".join(f"{c} binary" for c in (*names, "r"))
    asked = encoded.select("chunk", "tokens", "ids", "sizes", "train").mapInArrow(ask, form.schema)
    if width > 1:
        asked = materialize(asked, "katz-asked", large=True)
    table = materialize((asked if width == 1 else folded(asked, form, width)).groupBy("part").applyInArrow(merge, f"part int, chunks array<long>, asked array<binary>, {binary}, of array<array<long>>, hot boolean"), "katz-table", large=True)
    of = table.select(F.posexplode("of").alias("level", "n")).groupBy("level").agg(*[F.sum(F.get("n", F.lit(r))).alias(f"n{r}") for r in range(K + 1)]).collect()  # a row an order
    by_level = {x.level: np.array([x[f"n{r}"] or 0 for r in range(K + 1)], dtype=np.float64) for x in of}
    return table, [good_turing(by_level.get(level, np.zeros(K + 1))) for level in range(order - 1)], (asked, form) if width > 1 else None


#: By how many words a context has: those contexts' words, in order of the last one, and their sums (tokens, n-grams of each count up to K, held).
Known = dict[int, tuple[list[np.ndarray], np.ndarray]]


def _known(t: pa.Table, order: int) -> Known:
    """Sums of contexts that the exchange has brought to a partition."""
    names, size = [t[f"x{i}"].to_numpy() for i in range(order - 1)], t["size"].to_numpy()
    sums = np.stack([t[c].to_numpy() for c in ("total", *[f"n{r}" for r in range(1, K + 1)], "held")], axis=1)
    made = {}
    for many in np.unique(size).tolist():
        at = np.flatnonzero(size == many)
        at = at[np.argsort(names[0][at], kind="stable")]
        made[many] = [c[at] for c in names[:many]], sums[at]
    return made


def _spread_sums(names: list[np.ndarray], at: np.ndarray, known: list[np.ndarray], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the contexts ``at`` that are known, and their sums."""
    if not len(at):
        return at, sums[:0]
    lo, hi = np.searchsorted(known[0], names[0][at[0]]), np.searchsorted(known[0], names[0][at[-1]], side="right")
    first, which = _sorted_rows([np.append(k[lo:hi], c[at]) for k, c in zip(known, names)])
    found = np.full(len(first), -1)
    found[which[: hi - lo]] = np.arange(lo, hi)
    found = found[which[hi - lo :]]
    return at[found >= 0], sums[found[found >= 0]]


def spread_contexts(table: DataFrame, words: Words, order: int, discounts: list[np.ndarray]) -> DataFrame:
    """``part``, a context and its sums over all partitions, for each partition that has some of its n-grams; the shorter ones first, since the longer ones' sums rest on them."""
    told = table.sparkSession.sparkContext.broadcast((words, discounts))
    sums = ["total double", *[f"n{r} double" for r in range(1, K + 1)], "held double"]
    schema = ", ".join(["part int", "size int", *[f"x{i} long" for i in range(order - 1)], *sums])
    known = table.sparkSession.range(0, 0, 1, 1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in schema.split(", "))])
    hot = table.where("hot").select("part", *[f"c{i}" for i in range(order)], "r")
    for level in range(order - 2, -1, -1):
        known = known.unionByName(materialize(_one_order(hot, known, told, level, order, schema), "katz-spread"))
    return known


def _one_order(hot: DataFrame, known: DataFrame, told, level: int, order: int, schema: str) -> DataFrame:
    columns_of = known.columns

    def partial(rows: pa.Table, given: pa.Table) -> pa.Table:
        w, discounts = told.value
        columns, counts = _table(rows, 0, order, w)
        spread = salts(w, columns[0]) > 1
        columns, counts, known = [c[spread] for c in columns], counts[spread], _known(given, order)
        made = []
        for lo, hi in _runs(columns[0]):
            t = Table.of([c[lo:hi] for c in columns], counts[lo:hi])
            p = probabilities(t, w, discounts, known, level + 1)[t.lower[level]]
            total, n, held = t.sums(level, p)  # of those contexts too that have no count here but elsewhere
            names = [c.astype(np.int64) for c in t.names[level]]
            x = [names[i] if i < len(names) else np.full(len(total), -1) for i in range(order - 1)]
            of = [np.full(len(total), rows["part"][0].as_py(), dtype=np.int32), np.full(len(total), len(names), dtype=np.int32)]
            made.append(pa.table([pa.array(c) for c in (*of, *x, total, *n.T, held)], names=columns_of))
        return pa.concat_tables(made)

    some = hot.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(partial, schema)
    some = materialize(some, "katz-partial")
    context = ["size", *[f"x{i}" for i in range(order - 1)]]
    sums = [c for c in some.columns if c not in ("part", *context)]
    return some.select("part", *context).join(some.groupBy(*context).agg(*[F.sum(c).alias(c) for c in sums]), context).select(*some.columns)


def _few(x: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers of which few values occur, and often."""
    value, which = np.unique(x, return_inverse=True)
    return packed(value.view(np.uint64)), packed(which.astype(np.uint32))


def _logs(got: pa.Table) -> np.ndarray:
    """All that was answered, by partition."""
    order = np.argsort(got["part"].to_numpy()) if got.num_rows else []
    value, which = got["value"].to_pylist(), got["which"].to_pylist()
    return np.concatenate([np.zeros(0), *[unpacked(value[i], "u8").view(np.float64)[unpacked(which[i], "u4")] for i in order]])


def score(encoded: DataFrame, table: DataFrame, words: Words, order: int, discounts: list[np.ndarray], total: int, asked: tuple[DataFrame, Form] | None) -> DataFrame:
    """A row each text: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    parts = max(LEAST_PARTS, -(-total // PARTITION_TOKENS))
    told = encoded.sparkSession.sparkContext.broadcast((words, discounts))

    def look_up(rows: pa.Table | pa.RecordBatch, known: Known, i: int = 0) -> pa.RecordBatch:
        release()
        w, d = told.value
        columns, r = _table(rows, i, order, w)
        log = log_probabilities(columns, r, w, d, known)
        del columns, r
        release()
        made = [_few(log[risen(x).astype(np.int64)]) for x in rows["asked"][i].as_py()]
        value, which = zip(*made)
        return pa.RecordBatch.from_arrays([pa.array(rows["chunks"][i].as_py(), pa.int64()), pa.array([rows["part"][i].as_py()] * len(made), pa.int32()), pa.array(value, pa.binary()), pa.array(which, pa.binary())], names=["chunk", "part", "value", "which"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield look_up(b, {}, i)
        release()

    def together(rows: pa.Table, given: pa.Table) -> pa.Table:
        return pa.Table.from_batches([look_up(rows, _known(given, order))])

    schema = "chunk long, part int, value binary, which binary"
    known = spread_contexts(table, words, order, discounts)
    wanted = ["part", "chunks", "asked", *[f"c{i}" for i in range(order)], "r"]
    answers = table.where("NOT hot").select(*wanted).mapInArrow(alone, schema)
    answers = answers.unionByName(table.where("hot").select(*wanted).groupBy("part").cogroup(known.groupBy("part")).applyInArrow(together, schema))
    if asked:
        answers = unfolded(asked[0], answers, asked[1], width_for(parts), _logs, _few)
    answers = materialize(answers, "katz-answers", large=True)
    discard(table)
    if asked:
        discard(asked[0])

    def finish(chunk: pa.Table, got: pa.Table) -> pa.Table:
        release()
        w, _ = told.value
        tokens, ids, sizes, train = _chunk(chunk, 0)
        g = grams(tokens, ids, sizes, w, order, parts)
        log = _logs(got)
        token = ids.astype(np.int64)[tokens]
        each = np.log10(w.probability(token))
        asks = g.which >= 0
        each[asks] = log[g.which[asks]]
        c = w.count(token)
        base = np.log10((c + 1) / (w.tokens + w.types + 1))
        text = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda x: np.bincount(text, weights=x, minlength=len(sizes))
        keys = chunk["keys"].combine_chunks().flatten()
        return pa.table({"key": keys, "held_out": ~train, "n_tokens": sizes, "n_known": add(c > 0).astype(np.int64), "train_tokens": np.full(len(sizes), w.tokens, dtype=np.int64), "base_score": add(base), "score": add(each)})

    kind = encoded.schema["keys"].dataType.elementType.simpleString()
    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return encoded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def score_texts(documents: DataFrame, trains: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """An n-gram model of the texts for which ``trains`` holds, and the log10 probability of every text under it.

    Letters A-Z are lowered; a text's tokens are its words and one end; before the first there are as many
    beginnings as a context has words. Discounts are Good and Turing's, for each order, from all training counts;
    backoff weights make each context's probabilities sum to 1 exactly, over all training types and one
    for every other word. A token whose n-gram training has not seen gets its context's weight times
    what the context without its first word gives it, down to single words; a context that training has not seen
    weighs 1. ``base_score`` is the add-one unigram model's. ``order`` is 2 or more.

    A null or empty text is its end alone. Very long texts are chunks of their own, and are split a
    piece at a time. Null or repeated keys are scored row by row; a null ``trains`` counts as false. No
    training text: each token has the probability 1 of the only type there is. Empty input: no rows.
    Other columns do not matter, whatever their names.

    Texts are read once; chunks keep their tokens as numbers, and what is shuffled is one entry for
    each distinct word or n-gram of a chunk, so no word or n-gram is hot.
    """
    if order < 2:
        raise ValueError("order is 2 or more")
    local = local_tokens(documents, trains, key, text)
    total = local.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    encoded, words = encode(local)
    discard(local)
    table, discounts, asked = fit(encoded, words, order, total)
    return score(encoded, table, words, order, discounts, total, asked)


def digest(documents: DataFrame) -> DataFrame:
    learns = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return score_texts(documents, learns).withColumnRenamed("key", "doc_id")
