"""Removal of repeated word sequences, found by recompression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import discard, materialize, release
from .exchange import ASKED, asked, gathered, names, packed, parts_for, unpacked, width_for
from .words import mix, split

WINDOW = 20
#: Rounds that name pairs and runs; a round's symbols reach over twice the words or more, and ever fewer lie within a window.
ROUNDS = 3
#: Windows of a run at most, so that a run never meets itself from afar.
RUN = 20
_M = np.uint64(0x9E3779B97F4A7C15)
#: Words before or after a symbol that put its reach beyond any window.
_FAR = 4 * WINDOW
#: Chunks that a worker steps on with before it gives freed memory back, which must then be mapped anew.
_GIVE_BACK = 16
_steps = count()
#: A chunk between rounds, in columns of packed numbers, and what it asks.
_STATE = {"docs": "i8", "ends": "i8", "name": "u8", "at": "i8", "size": "u1", "before": "u1", "after": "u1", "begins": "?", "window": "i8", "best": "u8", "new": "?"}
_SCHEMA = "chunk long, symbols long, " + ", ".join(f"{c} binary" for c in _STATE) + f", {ASKED}"


@dataclass
class State:
    """What is left of a chunk: segments of symbols, and the windows that may still have an equal one elsewhere.

    A symbol stands for ``size`` words from ``at`` on (counted through the chunk); ``before`` and ``after``
    are the further words that decided on it. ``begins`` marks the first symbol of a segment. ``window``
    are first words of windows, rising, and ``best`` the anchor of each. Row r of the chunk has the words
    from ends[r] to ends[r + 1]. ``new`` are symbols that wait for a name: theirs is, so far, the place of
    their key among the distinct ones that the chunk asks, in order.
    """

    docs: np.ndarray
    ends: np.ndarray
    name: np.ndarray
    at: np.ndarray
    size: np.ndarray
    before: np.ndarray
    after: np.ndarray
    begins: np.ndarray
    window: np.ndarray
    best: np.ndarray
    new: np.ndarray | None = None

    def row(self, chunk: int, sent: pa.Array) -> pa.RecordBatch:
        held = {c: getattr(self, c) for c in _STATE}
        for c in ("at", "window", "ends"):
            held[c] = np.diff(held[c], prepend=0)
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(self.name)]), *[pa.array([packed(held[c].astype(kind))], pa.binary()) for c, kind in _STATE.items()], sent], names=["chunk", "symbols", *_STATE, "asked"])

    @staticmethod
    def of(b: pa.RecordBatch | pa.Table, i: int = 0) -> State:
        held = {c: unpacked(b[c][i].as_py(), kind) for c, kind in _STATE.items()}
        for c in ("at", "window", "ends"):
            held[c] = np.cumsum(held[c])
        return State(**{c: v.astype(np.int64) if v.dtype == np.uint8 else v for c, v in held.items()})


@dataclass
class Made:
    """The next symbols, in the places of those they stand for: which of the old ones each begins with, whether it is new, and the key that will name it."""

    first: np.ndarray
    new: np.ndarray
    key: np.ndarray
    size: np.ndarray
    before: np.ndarray
    after: np.ndarray


def compressed(s: State, k: int) -> Made:
    """One round: pairs of neighbours of which the left one's coin is 0 and the right one's is 1, then maximal runs of what is left.

    Coins depend on names alone. A pair is decided by its two symbols. A run, or a symbol that stays
    alone, is decided by its neighbours as well: by a neighbour's name, and where that is the same, by the
    pair that has taken the neighbour. At the edge of a segment there is no neighbour; what depends on
    one there is within no window that is still looked at.
    """
    n = len(s.name)
    if not n:
        return Made(s.at, s.begins, s.name, s.size, s.before, s.after)
    right = (mix(s.name + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
    ends_here = np.ones(n, dtype=bool)
    ends_here[:-1] = s.begins[1:]
    left_of = np.zeros(n, dtype=bool)  # is the left one of a pair
    left_of[:-1] = ~right[:-1] & right[1:] & ~s.begins[1:]
    right_of = np.zeros(n, dtype=bool)
    right_of[1:] = left_of[:-1]
    lo, hi = s.at - s.before, s.at + s.size + s.after  # the words that decided on each
    alone = ~left_of & ~right_of
    joined = np.zeros(n, dtype=bool)  # to the one before, in a run
    joined[1:] = alone[1:] & alone[:-1] & (s.name[1:] == s.name[:-1]) & ~s.begins[1:]
    first = np.flatnonzero(~right_of & ~joined)
    after_it = np.append(first[1:], n)
    last = after_it - 1
    pair, length = left_of[first], after_it - first
    run = ~pair & (length > 1)
    # what a run or single symbol at ``first`` .. ``last`` depends on at either side
    prev, next_ = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    prev_lo = np.where((s.name[prev] == s.name[first]) & right_of[prev], np.minimum(lo[prev], lo[np.maximum(prev - 1, 0)]), lo[prev])
    next_hi = np.where((s.name[next_] == s.name[last]) & left_of[next_], np.maximum(hi[next_], hi[np.minimum(next_ + 1, n - 1)]), hi[next_])
    new_lo = np.minimum(lo[first], lo[last])
    new_hi = np.maximum(hi[first], hi[last])
    new_lo = np.where(pair, new_lo, np.where(s.begins[first], s.at[first] - _FAR, np.minimum(new_lo, prev_lo)))
    new_hi = np.where(pair, new_hi, np.where(ends_here[last], s.at[last] + _FAR, np.maximum(new_hi, next_hi)))
    end = s.at[last] + s.size[last]
    key = np.where(pair, mix(s.name[first] * _M + s.name[last] + np.uint64(k)), mix(s.name[first] + _M * length.astype(np.uint64)))
    return Made(first, pair | run, key, end - s.at[first], s.at[first] - new_lo, new_hi - end)


def _anchored(best: np.ndarray, at: np.ndarray, size: np.ndarray, before: np.ndarray, after: np.ndarray, name: np.ndarray, keep: np.ndarray) -> None:
    """Raises ``best``, by first word of a window, to the widest symbol decided within the window; of several to the one whose name is highest."""
    reach = before + size + after
    ok = np.flatnonzero(keep & (reach <= WINDOW))
    value = (size[ok].astype(np.uint64) << np.uint64(58)) | (mix(name[ok]) >> np.uint64(6))
    lo, reach = (at - before)[ok], reach[ok]
    order = np.argsort(reach.astype(np.uint8), kind="stable")
    edge = np.searchsorted(reach[order], np.arange(WINDOW + 2))
    held = np.zeros(len(best), dtype=np.uint64)
    for r in range(1, WINDOW + 1):  # of symbols decided within r words from each on
        if r > 1:
            held[:-1] = np.maximum(held[:-1], held[1:])
        these = order[edge[r] : edge[r + 1]]
        if len(these):
            np.maximum.at(held, lo[these], value[these])
    np.maximum(best, held, out=best)


def _within(window: np.ndarray, lo: np.ndarray, reach: np.ndarray, places: int) -> np.ndarray:
    """Whether one of the windows holds all of ``reach`` (WINDOW at most) words from ``lo`` on."""
    upto = np.concatenate([[0], np.cumsum(np.bincount(window, minlength=places))])
    return upto[lo + 1] > upto[np.maximum(lo + reach - WINDOW, 0)]


def waiting(s: State, k: int) -> tuple[State, np.ndarray]:
    """The symbols that round k makes, and the keys of the new ones, which wait for names.

    A symbol is kept if a window that is left holds all that decided on it. In an equal window it is
    decided alike and kept as well, so no other symbol need be named: what stands beside one is at an edge.
    """
    made, places = compressed(s, k), int(s.ends[-1]) + 1
    reach = made.before + made.size + made.after
    place = np.flatnonzero(reach <= WINDOW)
    lo = s.at[made.first[place]] - made.before[place]
    place = place[_within(s.window, lo, reach[place], places)]
    first, new = made.first[place], made.new[place]
    begins = np.ones(len(place), dtype=bool)
    begins[1:] = (np.diff(place) > 1) | s.begins[first[1:]]
    best = s.best
    if k == 0 and len(s.window):  # the words themselves are anchors where nothing wider is decided in a window
        lo = s.at[first[new]] - made.before[place[new]]
        times = lambda x: np.bincount(x, minlength=places + 1)
        wider = np.cumsum(times(np.maximum(lo + reach[place[new]] - WINDOW, 0)) - times(lo + 1))
        bare = np.flatnonzero(wider[s.window] == 0)
        words_of = np.searchsorted(s.at, s.window[bare])[:, None] + np.arange(WINDOW)
        best = best.copy()
        best[bare] = np.max((np.uint64(1) << np.uint64(58)) | (mix(s.name[words_of]) >> np.uint64(6)), axis=1)
    return State(s.docs, s.ends, s.name[first], s.at[first], made.size[place], made.before[place], made.after[place], begins, s.window, best, new), made.key[place[new]]


def advance(s: State, answers: np.ndarray, anchors: bool = True) -> State:
    """The chunk now that its symbols have names; a symbol named 0 occurs once in all texts.

    A window that holds all that decided on such a symbol is equal to no other, and goes, as do symbols
    that no window holds any more; what stands beside them is at an edge.
    """
    places = int(s.ends[-1]) + 1
    name = s.name.copy()
    name[s.new] = answers[s.name[s.new].astype(np.int64)]
    lo, reach = s.at - s.before, s.before + s.size + s.after
    once = np.flatnonzero(name == 0)
    times = lambda x: np.bincount(x, minlength=places + 1)
    dead = np.cumsum(times(np.maximum((lo + reach)[once] - WINDOW, 0)) - times(lo[once] + 1))
    lives = dead[s.window] == 0
    window = s.window[lives]
    best = np.zeros(places, dtype=np.uint64)
    best[window] = s.best[lives]
    if anchors and len(window):
        _anchored(best, s.at, s.size, s.before, s.after, name, s.new & (name != 0))
    place = np.flatnonzero((name != 0) & _within(window, lo, reach, places))
    begins = np.ones(len(place), dtype=bool)
    begins[1:] = (np.diff(place) > 1) | s.begins[place[1:]]
    return State(s.docs, s.ends, name[place], s.at[place], s.size[place], s.before[place], s.after[place], begins, window, best[window])


def _start(documents: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """Chunks of documents: words by their place in the chunk's own vocabulary, which is what it asks."""

    most = words.CHUNK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found, ends in words.numbered_chunks(batches, 1, most):
            sent, ids = asked(found, *parts)
            held = [packed(b.column(0).to_numpy(zero_copy_only=False)), packed(np.diff(ends, prepend=0)), packed(ids.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in held], pa.array([len(ids)]), sent], names=["docs", "ends", "ids", "words", "asked"])

    made = documents.select("doc", "text").mapInArrow(run, f"docs binary, ends binary, ids binary, words long, {ASKED}")
    return materialize(made.withColumn("chunk", F.monotonically_increasing_id()), "recompress-words")


def _joined(rows: DataFrame, answers: DataFrame, step, schema: str) -> DataFrame:
    return rows.drop("asked").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(step, schema)


def _total(rows: DataFrame, column: str) -> int:
    return rows.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]


def _parts(keys: int) -> tuple[int, int]:
    """Partitions, and how many of them a region has."""
    parts = parts_for(keys)
    return parts, width_for(parts)


def _lists(documents: DataFrame) -> DataFrame:
    """``doc, runs`` (at, n, name) of the documents that have windows left after the last round.

    Each round names what occurs, over all chunks, in one exchange. Who names symbols makes the next ones
    at once and asks for their names, so partitions are counted by what was known a step before: bytes of
    text (about one in 18 is a distinct word of a chunk), words, and then the symbols of the round before.
    """
    parts = _parts(_total(documents.select(F.octet_length("text").alias("bytes")), "bytes") // 18)
    state = _start(documents, parts)
    answers = names(state, *parts, "recompress-word-names")
    parts = _parts(_total(state, "words") // 3)

    def begin(chunk: pa.Table, got: pa.Table) -> pa.Table:
        _stepped()
        ids = unpacked(chunk["ids"][0].as_py(), "u4")
        ends = np.cumsum(unpacked(chunk["ends"][0].as_py(), "i8"))
        n = len(ids)
        begins = np.zeros(n + 1, dtype=bool)
        begins[ends] = True
        at = np.arange(n)
        window = at[at + WINDOW <= np.repeat(ends[1:], np.diff(ends))]
        none, one = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
        s = State(unpacked(chunk["docs"][0].as_py(), "i8"), ends, ids.astype(np.uint64), at, one, none, none, begins[:-1], window, np.zeros(len(window), dtype=np.uint64), one.astype(bool))
        return _asking(advance(s, gathered(got, "names", "u8"), anchors=False), 0, chunk, parts)

    state = _after(state, answers, begin, _SCHEMA, "recompress-state")
    for k in range(ROUNDS):
        answers = names(state, *parts, f"recompress-names-{k}")
        parts = _parts(_total(state, "symbols") // 3)
        state = _after(state, answers, _step(k, parts), *((_SCHEMA, "recompress-state") if k + 1 < ROUNDS else (_LISTS, "recompress-lists")))
    return state


def _after(rows: DataFrame, answers: DataFrame, step, schema: str, table: str) -> DataFrame:
    made = materialize(_joined(rows, answers, step, schema), table)
    discard(rows)
    discard(answers)
    return made


def _stepped() -> None:
    if next(_steps) % _GIVE_BACK == 0:
        release()


def _asking(s: State, k: int, chunk: pa.Table, parts: tuple[int, int]) -> pa.Table:
    s, keys = waiting(s, k)
    sent, which = asked(keys, *parts)
    s.name[s.new] = which
    return pa.Table.from_batches([s.row(chunk["chunk"][0].as_py(), sent)])


def _step(k: int, parts: tuple[int, int]):
    """Names the symbols of round k, and makes the next, or after the last round lists the runs of windows."""

    def step(chunk: pa.Table, got: pa.Table) -> pa.Table:
        _stepped()
        s = advance(State.of(chunk), gathered(got, "names", "u8"))
        return _asking(s, k + 1, chunk, parts) if k + 1 < ROUNDS else pa.Table.from_batches([listed(s)])

    return step


def runs(s: State) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word in the row, windows, name) of the runs of neighbouring windows that share an anchor."""
    row = np.searchsorted(s.ends, s.window, side="right") - 1
    new = np.ones(len(s.window), dtype=bool)
    new[1:] = (s.best[1:] != s.best[:-1]) | (row[1:] != row[:-1]) | (np.diff(s.window) > 1)
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    new |= (np.arange(len(new)) - head) % RUN == 0
    first = np.flatnonzero(new)
    return row[first], s.window[first] - s.ends[row[first]], np.diff(np.append(first, len(new))), s.best[first]


_LISTS = "doc long, runs array<struct<at: long, n: long, name: long>>"


def listed(s: State) -> pa.RecordBatch:
    """A row for each document of the chunk that has windows left."""
    row, at, n, name = runs(s)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]]) if len(row) else np.zeros(1, dtype=np.int64)
    rows = pa.StructArray.from_arrays([pa.array(at), pa.array(n.astype(np.int64)), pa.array(name.view(np.int64))], names=["at", "n", "name"])
    return pa.RecordBatch.from_arrays([pa.array(s.docs[row[cut[:-1]]]), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), rows)], names=["doc", "runs"])


def _digests(words: list[bytes], at: list[int], n: list[int]) -> np.ndarray:
    """128 bits of the words themselves, joined, of each run of words: two numbers a row."""
    made = b"".join(xxhash.xxh3_128_digest(b" ".join(words[a : a + c])) for a, c in zip(at, n))
    return np.frombuffer(made, dtype=np.int64).reshape(-1, 2)


#: Whether two windows of a run are equal, so that it must be looked at window by window.
OPEN, SINGLE = 0, 1


def _meets_itself(words: list[bytes], at: int, n: int) -> bool:
    """Whether two of ``n`` windows (RUN at most) from ``at`` on are equal.

    Whichever they are, the later one holds the words from the last window's first to the one after the
    first window; so these must stand some words earlier as well, which few runs pass.
    """
    lo, hi = at + n - 1, at + WINDOW + 1
    if words[lo] not in words[at:lo]:
        return False
    shared = words[lo:hi]
    if not any(words[lo - d : hi - d] == shared for d in range(1, n)):
        return False
    return len({tuple(words[i : i + WINDOW]) for i in range(at, at + n)}) < n


def _met(documents: DataFrame, lists: DataFrame, step, schema: str) -> DataFrame:
    """``step`` of (doc, words, at, n, name) for each row of the documents that ``lists`` has runs of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in enumerate(b.column(1).cast(pa.large_binary())):
                held = b.column(2)[i].values
                at, n, name = (held.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                out.append(step(b.column(0)[i].as_py(), split(text.as_py()), at, n, name))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_arrow(schema))

    return documents.join(lists, "doc").select("doc", "text", "runs").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _found(documents: DataFrame, lists: DataFrame) -> DataFrame:
    """All runs, with a digest of their words; ``state`` tells whether two windows of the run are equal."""

    def step(doc: int, words: list[bytes], at: np.ndarray, n: np.ndarray, name: np.ndarray) -> tuple:
        span = _digests(words, at.tolist(), (n + WINDOW - 1).tolist())
        itself = np.array([SINGLE if _meets_itself(words, a, c) else OPEN for a, c in zip(at.tolist(), n.tolist())], dtype=np.int32)
        return name, span[:, 0], span[:, 1], np.full(len(at), doc), at, n.astype(np.int32), itself

    return _met(documents, lists, step, "name long, span0 long, span1 long, doc long, at long, n int, state int")


def _spans(documents: DataFrame) -> DataFrame:
    """``doc, spans``: runs of windows (first word, windows) each of which has an equal one that starts earlier.

    Runs of equal words have one digest; all but the first of them are later, whole. Names of which more than
    one digest is known have runs that may share some windows only: of each digest, the first is looked at
    window by window, as are runs that meet themselves. All is aggregated map-side, so that a common
    passage is one row from each task.
    """
    lists = _lists(documents)
    found = materialize(_found(documents, lists), "recompress-found")
    discard(lists)
    place = F.struct("doc", "at")
    spans = found.groupBy("name", "span0", "span1").agg(F.min(place).alias("first"), F.min("n").alias("n"), F.max("state").alias("state"), F.count("*").alias("times"))
    spans = materialize(spans, "recompress-contents")
    several = materialize(spans.groupBy("name").agg(F.count("*").alias("contents")).where("contents > 1").select("name"), "recompress-several")
    looked = spans.join(several.withColumn("mixed", F.lit(True)), "name", "left").where(f"mixed OR state = {SINGLE}")
    runs = looked.select("name", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), F.col("n").cast("long").alias("n"))
    runs = materialize(runs.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "name")).alias("runs")), "recompress-single")

    def windows(doc: int, words: list[bytes], at: np.ndarray, n: np.ndarray, name: np.ndarray) -> tuple:
        start = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        each = _digests(words, start.tolist(), [WINDOW] * len(start))
        return np.repeat(name, n), each[:, 0], each[:, 1], np.full(len(start), doc), start

    windows = materialize(_met(documents, runs, windows, "name long, hash0 long, hash1 long, doc long, at long"), "recompress-windows")
    keys = ["name", "hash0", "hash1"]
    first = windows.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("count")).where("count > 1").drop("count")
    first = materialize(first, "recompress-firsts")
    late = windows.join(first, keys).where("NOT (struct(doc, at) <=> first)").select("doc", "at", F.lit(1).alias("n"))
    repeated = spans.where("times > 1").select("name", "span0", "span1", "first")
    whole = found.join(repeated, ["name", "span0", "span1"]).where("NOT (struct(doc, at) <=> first)").select("doc", "at", "n")
    both = whole.unionByName(late)
    return both.groupBy("doc").agg(F.collect_list(F.struct(F.col("at"), F.col("n").cast("long").alias("n"))).alias("spans"))


def _numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with ``_bw_doc``: whole numbers that order its documents.

    The key itself where it is one, never null and never twice; else numbers by key and hash of the
    text, nulls first, the same for rows equal in both.
    """
    whole = df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    odd = df.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL")
    if whole and odd.isEmpty():
        return df.withColumn("_bw_doc", F.col(f"`{key}`").cast("long"))
    keyed = df.withColumn("_bw_hash", F.xxhash64(text))
    known = keyed.select(F.col(f"`{key}`").alias("_bw_key"), F.col("_bw_hash").alias("_bw_h")).distinct()
    known = known.repartitionByRange("_bw_key", "_bw_h").sortWithinPartitions("_bw_key", "_bw_h").withColumn("_bw_doc", F.monotonically_increasing_id())
    known = materialize(known, "recompress-numbers")
    same = F.col(f"`{key}`").eqNullSafe(F.col("_bw_key")) & (F.col("_bw_hash") == F.col("_bw_h"))
    return keyed.join(known, same).drop("_bw_key", "_bw_h", "_bw_hash")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the words that repeat gone from ``text``, ``n_words`` and ``n_removed`` (both long).

    Words are what stands between ASCII white characters. A window is 20 consecutive words of one
    text; a word goes if a window covers it whose words also start earlier (a smaller key, or the same
    document, earlier). Windows are judged on the input. The words that stay are joined by one space.

    Recompression: each round replaces pairs and runs of symbols by one symbol each, which an exchange over
    all chunks names, so equal passages have equal symbols inside. A symbol that occurs once proves all
    windows around it unique; they drop out, and later rounds see what is left. Each window left is
    filed under its widest symbol decided within it; runs of windows filed alike meet all others of that
    name. What decides, at last, are 128-bit digests of the words themselves: of whole runs, and where those
    differ, of each window.

    A null text has no words and stays null; texts of fewer words than a window stay but for their
    white space. Null keys come first; rows with one key but other texts follow their texts' hashes;
    rows equal in both are one document. Other columns pass through; ones named n_words or n_removed
    are replaced. Empty input: no rows.
    """
    names = [c for c in df.columns if c not in ("n_words", "n_removed")]
    rows = _numbered(df.select(*[F.col(f"`{c}`") for c in names]), key, text)
    spans = _spans(rows.select(F.col("_bw_doc").alias("doc"), F.col(f"`{text}`").alias("text")))
    met = rows.join(spans.select(F.col("doc").alias("_bw_at"), F.col("spans").alias("_bw_spans")), F.col("_bw_doc") == F.col("_bw_at"), "left").drop("_bw_doc", "_bw_at")
    where = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                made = [_kept(t, s or []) for t, s in zip(part.column(where).cast(pa.large_binary()).to_pylist(), part.column(len(names)).to_pylist())]
                columns = list(part.columns[: len(names)])
                columns[where] = pa.array([m[0] for m in made], columns[where].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=[*names, "n_words", "n_removed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in names]).schema.fields)
    return met.mapInArrow(run, f"{fields}, n_words long, n_removed long")


def _kept(t: bytes | None, spans: list[dict]) -> tuple[bytes | None, int, int]:
    if t is None:
        return None, 0, 0
    words = split(t)
    if not spans:
        return b" ".join(words), len(words), 0
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        mark[s["at"]] += 1
        mark[s["at"] + s["n"] + WINDOW - 1] -= 1
    gone = np.cumsum(mark[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g), len(words), int(gone.sum())


def digest(documents: DataFrame) -> DataFrame:
    """Per document: its words, those removed, and a checksum of those kept."""
    out = remove_repeats(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: Rows with several documents of one id are not told apart here; the tables have none.
SQL = f"""
WITH word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
), wide AS (
  SELECT doc_id, pos, word, string_agg(word, ' ') OVER w AS words, count(*) OVER w AS n FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), ranked AS (
  SELECT doc_id, pos, word, CASE WHEN n = {WINDOW} AND row_number() OVER (PARTITION BY words, n ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS late FROM wide
), marked AS (
  SELECT doc_id, pos, word, max(late) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM ranked
), made AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN made USING (doc_id)
"""
