"""SimHash near-duplicates, joined by walking pairs of binary-trie nodes together."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, connected_components, discard, materialize, release, text_key

#: A pair of nodes with at most so many pairs of leaves is compared leaf by leaf: a leaf with a leaf.
LEAF_PAIRS = 1
#: Pairs of nodes walked at a time, and pairs of leaves compared at a time; bound the memory.
BATCH = 1 << 16
#: Fingerprints that share a block's value and are joined in one group; larger ones are split.
GROUP_ROWS = 1 << 16


def _bits(hashes: np.ndarray) -> np.uint64:
    """Bit i is 1 where over half of the hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).view(">u8")[0].astype(np.uint64)


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned SimHash of a whole text; 0 where it has no word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six white characters
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        return digest(b" ".join(found), 42)
    joined, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(ends) - words]]]
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :])), dtype=np.uint64, count=len(starts))
    return int(_bits(hashes))


def word_fingerprint(text: str | None) -> int:
    """Unsigned SimHash of a whole text's distinct words, the longer ones weighing more; 0 where it has none.

    A changed word changes one feature, not one for each shingle over it, and function words hardly
    weigh: texts whose five-word shingles are 0.8 similar differ in few bits.
    """
    found = list(dict.fromkeys((text or "").encode("utf-8", "surrogatepass").lower().split()))
    if not found:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in found), dtype=np.uint64, count=len(found))
    weight = np.fromiter((max(len(w) - 3, 0.01) for w in found), dtype=np.float64, count=len(found))
    for_one = np.zeros(64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        for_one += weight[at : at + (1 << 16)] @ np.unpackbits(part, axis=1)
    return int(np.packbits(for_one * 2 > weight.sum()).view(">u8")[0])


def with_fingerprints(df: DataFrame, words: int | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``fp`` (signed 64 bits) of each row: over shingles of so many words, or None: distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([word_fingerprint(t) if words is None else fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, fp long")


def blocks_for(n: int, bits: int) -> int:
    """Blocks to cut a fingerprint into so that, with all but ``bits`` of them equal, few share a key."""
    m = bits + 1
    while m < 16 and n >> (64 * (m - bits) // m) > 1024:
        m += 1
    return m


def _masks(m: int, bits: int) -> list[int]:
    """One mask for each choice of the blocks that ``bits`` wrong bits leave whole."""
    from itertools import combinations

    edges = [64 * i // m for i in range(m + 1)]
    whole = [((1 << (edges[i + 1] - edges[i])) - 1) << (64 - edges[i + 1]) for i in range(m)]
    return [sum(whole[i] for i in c) for c in combinations(range(m), m - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, n: int, bits: int) -> DataFrame:
    """``src, dst``: a forest over the distinct ``fp`` that connects all pairs at ``bits`` or fewer.

    With b wrong bits at most, m - b of m blocks are equal in any such pair. So each choice of m - b
    blocks makes a trie whose upper levels have no error to spend, and all below one of its
    nodes is one group. In each group the trie over all 64 bits is walked in pairs of nodes.
    """
    masks = _masks(blocks_for(n, bits), bits)
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(k))).alias("k")) for i, k in enumerate(masks)])).alias("x")).select("fp", F.xxhash64("x.t", "x.k").alias("g"))
    # A group over GROUP_ROWS is dealt out in pairs of its parts; any two of its rows meet in one.
    large = materialize(rows.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > GROUP_ROWS), "simhash-large")
    if not large.isEmpty():
        parts = F.coalesce(F.ceil(F.col("c") / GROUP_ROWS), F.lit(1)).cast("int") * 2
        mine = F.pmod(F.xxhash64("fp"), F.col("p")).cast("int")
        split = rows.join(large, "g", "left").withColumn("p", F.when(F.col("c").isNull(), 1).otherwise(parts)).withColumn("i", mine)
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.struct(F.least("i", j).alias("a"), F.greatest("i", j).alias("b"))))
        rows = split.select("fp", "g", "p", pair.alias("x")).select("fp", F.when(F.col("p") == 1, F.col("g")).otherwise(F.xxhash64("g", "x.a", "x.b")).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if got:
            src, dst = group_links(np.concatenate([g for g, _ in got]), np.concatenate([x for _, x in got]).view(np.uint64), bits)
            for at in range(0, len(src), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(src[at : at + (1 << 16)].view(np.int64)), pa.array(dst[at : at + (1 << 16)].view(np.int64))], names=["src", "dst"])

    return rows.repartition("g").select("g", "fp").mapInArrow(run, "src long, dst long")


def _prefix(x: np.ndarray) -> np.ndarray:
    """Leading zeros of each."""
    n = np.full(x.shape, 64, dtype=np.int64)
    x = x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = x >> np.uint64(step) != 0
        n[big] -= step
        x[big] >>= np.uint64(step)
    return n - (x != 0)


def group_links(group: np.ndarray, x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one group: each to the least that it is connected with."""
    order = np.lexsort((x, group))
    group, x = group[order], x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (x[1:] != x[:-1])
    group, x = group[new], x[new]
    n = len(x)
    forest = Forest(n)
    near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(x[1:] ^ x[:-1]) <= bits))
    forest.join(near, near + 1)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, dtype=np.int64)
    last = np.concatenate([first[1:], [n]]) if n else first
    many = last - first > 1
    stack = [np.stack([first[many], last[many], first[many], last[many]])]
    leaves: list[np.ndarray] = []
    waiting = 0

    def compare() -> None:
        nonlocal waiting
        if not leaves:
            return
        a0, a1, b0, b1 = np.concatenate(leaves, axis=1)
        leaves.clear()
        waiting = 0
        open_ = ~forest.one(a0, a1, b0, b1)
        a0, a1, b0, b1 = a0[open_], a1[open_], b0[open_], b1[open_]
        width, size = b1 - b0, (a1 - a0) * (b1 - b0)
        for lo, hi in _cuts(size):
            s, w = size[lo:hi], width[lo:hi]
            at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            w = np.repeat(w, s)
            i, j = np.repeat(a0[lo:hi], s) + at // w, np.repeat(b0[lo:hi], s) + at % w
            hit = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= bits)
            forest.join(i[hit], j[hit])

    while stack:
        a0, a1, b0, b1 = stack.pop()
        if len(a0) > BATCH:
            half = len(a0) // 2
            stack += [np.stack([a0[:half], a1[:half], b0[:half], b1[:half]]), np.stack([a0[half:], a1[half:], b0[half:], b1[half:]])]
            continue
        # the bits that both nodes have in common with all below them; their difference is the error so far
        shared_a, shared_b = _prefix(x[a0] ^ x[a1 - 1]), _prefix(x[b0] ^ x[b1 - 1])
        shared = np.minimum(shared_a, shared_b)
        head = np.where(shared == 0, np.uint64(0), (x[a0] ^ x[b0]) >> (np.uint64(64) - np.maximum(shared, 1).astype(np.uint64)))
        open_ = (np.bitwise_count(head) <= bits) & ~forest.one(a0, a1, b0, b1)
        a0, a1, b0, b1, shared_a, shared_b, shared = (v[open_] for v in (a0, a1, b0, b1, shared_a, shared_b, shared))
        small = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS
        if small.any():
            leaves.append(np.stack([a0[small], a1[small], b0[small], b1[small]]))
            waiting += int(small.sum())
            if waiting >= BATCH // 16:
                compare()
        a0, a1, b0, b1, shared_a, shared_b, shared = (v[~small] for v in (a0, a1, b0, b1, shared_a, shared_b, shared))
        if not len(a0):
            continue
        same = (a0 == b0) & (a1 == b1)
        mid_a, mid_b = _split(x, a0, a1, shared_a), _split(x, b0, b1, shared_b)
        cut_a, cut_b = shared_a == shared, shared_b == shared
        both, only_a, only_b = cut_a & cut_b & ~same, cut_a & ~cut_b, cut_b & ~cut_a
        out = [np.stack(c) for c in (
            (a0[same], mid_a[same], a0[same], mid_a[same]), (mid_a[same], a1[same], mid_a[same], a1[same]), (a0[same], mid_a[same], mid_a[same], a1[same]),
            (a0[both], mid_a[both], b0[both], mid_b[both]), (a0[both], mid_a[both], mid_b[both], b1[both]), (mid_a[both], a1[both], b0[both], mid_b[both]), (mid_a[both], a1[both], mid_b[both], b1[both]),
            (a0[only_a], mid_a[only_a], b0[only_a], b1[only_a]), (mid_a[only_a], a1[only_a], b0[only_a], b1[only_a]),
            (a0[only_b], a1[only_b], b0[only_b], mid_b[only_b]), (a0[only_b], a1[only_b], mid_b[only_b], b1[only_b]),
        )]
        stack.append(np.concatenate(out, axis=1))
    compare()
    moved = np.flatnonzero(forest.label != np.arange(n))
    return x[moved], x[forest.label[moved]]


def _cuts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of about 16 BATCH pairs of leaves."""
    total = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 16 * BATCH, side="right"))
        yield lo, max(hi, lo + 1)
        lo = max(hi, lo + 1)


def _split(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Of sorted runs that agree in ``shared`` bits: where the next bit turns to 1."""
    shift = np.uint64(63) - np.minimum(shared, 63).astype(np.uint64)
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (x[np.minimum(mid, len(x) - 1)] >> shift) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


#: Copies of a fingerprint at most where the walk only looks for candidates.
MOST_COPIES = 64


def affordable(n: int, bits: int, copies: int) -> int:
    """``bits``, or as many fewer as it takes for n fingerprints to go to ``copies`` groups each at most."""
    while bits and math.comb(blocks_for(n, bits), bits) > copies:
        bits -= 1
    return bits


def near_duplicates(df: DataFrame, words: int | None = 4, bits: int = 4, key: str = "doc_id", text: str = "text", copies: int | None = None) -> DataFrame:
    """``key, fp, component_id`` of each row: rows are linked where fingerprints differ in ``bits`` or fewer.

    A fingerprint is the SimHash of the lower-cased text's word shingles, repeats included, by
    XXH64 with seed 42 (a text of fewer words: its whole sequence; none or null: fingerprint zero,
    linked like any other). Equal fingerprints are one from the start, so copies of any number cost
    one row; the distinct ones are joined by the trie walk of :func:`links`, which unites rows as it
    goes and skips nodes already united, so a dense group costs no pair of its members a row.
    component_id is the least key reachable; null keys count as none (all null: null). Rows that
    repeat are each returned; very long texts are read whole. Empty input: no rows. Other columns do not matter.
    ``copies``, for a search of candidates only: ``bits`` is lowered where a fingerprint would go to more groups.
    """
    prints = materialize(with_fingerprints(df, words, text, key), "simhash-fp")
    classes = materialize(prints.groupBy("fp").agg(F.min("key").alias("least")), "simhash-classes")
    n = classes.count()
    found = materialize(links(classes.select("fp"), n, bits if copies is None else affordable(n, bits, copies)), "simhash-links")
    member = connected_components(found)
    rooted = classes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found))], dtype=np.uint64)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[i : i + words])) for i in range(len(found) - words + 1)), dtype=np.uint64, count=len(found) - words + 1))


#: Distinct texts, and shingles of theirs, that are compared in one task on either side; and shingles counted at a time.
VERIFY_ROWS, VERIFY_SHINGLES, VERIFY_COLUMNS = 2048, 1 << 20, 1024


def verified_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects the texts of ``left`` and ``right`` (all pairs of one side, if they are the same) whose Jaccard similarity reaches ``similarity``.

    What two sets share is counted exactly, in products of blocks of the 0-1 matrix of sets and those shingles
    that more than one set has.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, VERIFY_COLUMNS):
        at = slice(np.searchsorted(column, lo), np.searchsorted(column, lo + VERIFY_COLUMNS))
        has = np.zeros((len(sets), VERIFY_COLUMNS), dtype=np.float32)
        has[owner[at], column[at] - lo] = 1
        both += has[left] @ has[right].T
    forest = Forest(len(sets))
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        part = both[at : at + 256].astype(np.float64)
        i, j = np.nonzero(part >= similarity * (sizes[rows][:, None] + sizes[right][None, :] - part))
        forest.join(rows[i], right[j])
    moved = np.flatnonzero(forest.label != np.arange(len(sets)))
    return moved, forest.label[moved]


def _in_groups(held: DataFrame, similarity: float) -> DataFrame:
    """``src, dst``: a forest over the ``m`` of each ``root``'s rows (m, root, parts, shingles), all of whose pairs are looked at."""
    held = held.withColumn("i", F.pmod(F.xxhash64("m"), F.col("parts")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("i", j).alias("a"), F.greatest("i", j).alias("b"))))
    dealt = held.select("m", "root", "shingles", "i", pair.alias("t")).select("m", "root", "shingles", "i", "t.a", "t.b")

    def verify(t: pa.Table) -> pa.Table:
        made = [np.frombuffer(s, dtype=np.uint64) for s in t["shingles"].to_pylist()]
        m, a, b = t["m"].to_numpy(), t["a"][0].as_py(), t["b"][0].as_py()
        side = t["i"].to_numpy() == a
        left = np.flatnonzero(side)
        src, dst = verified_links(made, left, left if a == b else np.flatnonzero(~side), similarity)
        return pa.table({"src": m[src], "dst": m[dst]})

    return dealt.groupBy("root", "a", "b").applyInArrow(verify, "src long, dst long")


#: Texts with one shingle in their prefixes whose pairs are written out; larger groups are compared in blocks.
PAIR_ROWS = 64
#: The order is made from one text in so many, in so many rounds; each moves so many shingles to its end at most.
SAMPLE, ROUNDS, LATE = 8, 2, 1 << 20
#: Bits of a set's sketch.
SKETCH = 4096


def prefix(shingles: np.ndarray, similarity: float, late: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in an order that all sets have in common: those of ``late`` (sorted) come last.

    Of two sets whose Jaccard similarity reaches ``similarity``, one has at least that share of the other,
    so what each has in front of its last ``ceil(similarity * n) - 1`` shingles must meet.
    """
    n = len(shingles)
    if len(late):
        at = np.minimum(np.searchsorted(late, shingles), len(late) - 1)
        last = late[at] == shingles
        shingles = np.concatenate([shingles[~last], shingles[last]])
    return shingles[: n - math.ceil(similarity * n - 1e-9) + 1]


def close_rows(group: np.ndarray, m: np.ndarray, part: np.ndarray, place: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``m`` of one group (rows sorted by group) and of different parts that sizes and places do not rule out."""
    src, dst = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for d in range(1, len(group)):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        j = i + d
        a, b = size[i].astype(np.float64), size[j].astype(np.float64)
        # if it is the first that they share, they share it and at most what comes after it in both
        most = 1 + np.minimum(a - place[i] - 1, b - place[j] - 1)
        open_ = (part[i] != part[j]) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6) & (most >= similarity / (1 + similarity) * (a + b) - 1e-6)
        i, j = i[open_], j[open_]
        src.append(np.minimum(m[i], m[j]))
        dst.append(np.maximum(m[i], m[j]))
    both = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def sketch(shingles: np.ndarray) -> bytes:
    """Whether the shingles of each remainder are an odd number: two sets differ in no fewer shingles than their sketches do in bits."""
    return np.packbits(np.bincount((shingles % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingle_set(t, words).tobytes() for t in some.column(1).to_pylist()], pa.binary())], names=["m", "shingles"])

    return run


def agreeing(asked: DataFrame, texts: Callable[[DataFrame], DataFrame], named: DataFrame, words: int, similarity: float, likely: bool = False) -> DataFrame:
    """Those of the pairs ``asked`` (src, dst) whose Jaccard similarity reaches ``similarity``: shingles decide, and where most pairs are not ``likely`` to, sketches rule them out before."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(len(x), sketch(x)) for x in (shingle_set(t, words) for t in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names=["m", "size", "sketch"])

    def of(ids: DataFrame) -> DataFrame:
        return texts(named.join(ids, "m")).select("m", "text")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("src").alias("m")).union(pairs.select(F.col("dst").alias("m"))).distinct()

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1) for k in (3, 5))
            size = b.column(2).to_numpy().astype(np.float64) + b.column(4).to_numpy()
            # what similar sets differ in, at most
            at = pa.array(np.flatnonzero(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * size + 1e-6))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["src", "dst"])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(both >= similarity * (len(x) + len(y) - both))
            at = pa.array(np.flatnonzero(same))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["src", "dst"])

    left = asked
    if not likely:
        short = materialize(of(ends(asked)).mapInArrow(sketches, "m long, size int, sketch binary"), "pairs-sketches")
        seen = asked.join(short.toDF("src", "a", "x"), "src").join(short.toDF("dst", "b", "y"), "dst").select("src", "dst", "a", "x", "b", "y")
        left = materialize(seen.mapInArrow(open_, "src long, dst long"), "pairs-open")
        discard(short)
    held = materialize(of(ends(left)).mapInArrow(_sets(words), "m long, shingles binary"), "pairs-sets")
    both = left.join(held.toDF("src", "x"), "src").join(held.toDF("dst", "y"), "dst").select("src", "dst", "x", "y")
    near = materialize(both.mapInArrow(agree, "src long, dst long"), "pairs-near")
    discard(held)
    return near


def prefix_links(texts: Callable[[DataFrame], DataFrame], named: DataFrame, words: int, similarity: float) -> DataFrame:
    """``src, dst``: links that join all ``m`` of ``named`` (m, part) of different parts whose similarity reaches ``similarity``.

    ``texts`` gives rows (m, ..., text) of a table with ``m``. No pair is left out: any shares a shingle of
    its prefixes, whatever the order. The order only decides the cost: shingles that many prefixes have
    are moved to its end. Pairs that already are of one part are not looked at.
    """
    spark = named.sparkSession

    def rows(of: DataFrame, late: np.ndarray) -> DataFrame:
        told = spark.sparkContext.broadcast(late)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    some = b.slice(at, 256)
                    sets = [shingle_set(t, words) for t in some.column(2).to_pylist()]
                    cut = [prefix(s, similarity, told.value) for s in sets]
                    n = np.array([len(c) for c in cut], dtype=np.int64)
                    own = np.repeat(np.arange(len(cut)), n)
                    place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                    size = np.array([len(s) for s in sets], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cut).view(np.int64)), some.column(0).take(pa.array(own)), some.column(1).take(pa.array(own)), pa.array(place.astype(np.int32)), pa.array(size[own])], names=["shingle", "m", "part", "place", "size"])

        return materialize(texts(of).select("m", "part", "text").mapInArrow(run, "shingle long, m long, part long, place int, size int"), "prefix-rows")

    def met(made: DataFrame) -> DataFrame:
        all_ = made.groupBy("shingle").agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"))
        return all_.where("lo <> hi").select("shingle", "n")

    late = np.zeros(0, dtype=np.uint64)
    for _ in range(ROUNDS):
        some = rows(named.where(F.pmod(F.xxhash64("m"), F.lit(SAMPLE)) == 0), late)
        often = met(some).where(F.col("n") > max(1, PAIR_ROWS // SAMPLE // 2)).orderBy(F.desc("n"), "shingle").limit(LATE).select("shingle").toPandas()
        discard(some)
        before, late = len(late), np.union1d(late, often["shingle"].to_numpy(dtype=np.int64).view(np.uint64))
        if len(late) == before:
            break
    made = rows(named, late)
    groups = materialize(met(made), "prefix-met")
    hot = groups.where(F.col("n") > PAIR_ROWS)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.flatnonzero(held[0] == held[0][-1])[0]) if len(held[0]) else 0  # the last group may go on
            if cut:
                src, dst = close_rows(*[x[:cut] for x in held], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])
                held = [x[cut:] for x in held]
        if held is not None:
            src, dst = close_rows(*held, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    few = made.join(groups.where(F.col("n") <= PAIR_ROWS).select("shingle"), "shingle").select("shingle", "m", "part", "place", "size")
    few = few.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(pairs, "src long, dst long")
    asked = materialize(few.distinct(), "prefix-pairs")
    # groups of equal members are one; all pairs of a larger one are looked at, in blocks
    many = materialize(made.join(hot.select("shingle"), "shingle").select("shingle", "m", "size"), "prefix-many")
    discard(made)
    lists = many.groupBy("shingle").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor(F.xxhash64("m")).alias("x0"), F.bit_xor(F.xxhash64(F.lit("second"), "m")).alias("x1"))
    lists = materialize(lists.groupBy("n", "shingles", "x0", "x1").agg(F.min("shingle").alias("shingle")), "prefix-lists")
    blocks = F.greatest(F.ceil(F.col("n") / VERIFY_ROWS), F.ceil(F.col("shingles") / VERIFY_SHINGLES)).cast("int")
    dealt = many.join(lists, "shingle").select("m", F.col("shingle").alias("root"), blocks.alias("parts"))

    sets = _sets(words)
    near = agreeing(asked, texts, named, words, similarity)
    if not lists.isEmpty():
        wanted = materialize(named.join(dealt.select("m").distinct(), "m"), "prefix-wanted")
        held = materialize(texts(wanted).select("m", "text").mapInArrow(sets, "m long, shingles binary"), "prefix-block-sets")
        near = near.unionByName(materialize(_in_groups(dealt.join(held, "m"), similarity), "prefix-blocks"))
        discard(held)
    return near


def keep_one(df: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one document of each group of near-duplicates: the one with the least key.

    Equal texts are a group; the least key stands for all. Texts are linked where the Jaccard similarity
    of their sets of word shingles, looked at exactly, is ``similarity`` or more. Candidates come
    on two ways. First each text that the trie walk connects with others, by SimHash of distinct words
    within ``bits`` (fewer where that would copy fingerprints more than MOST_COPIES times), is looked at beside the first of those, one pair a text, which unites dense groups
    at little cost. Then, of texts not yet united, all that share a shingle of their prefixes
    (:func:`prefix_links`), so that no pair is missed.

    Rows equal in key and text are one document and share its fate. Rows with a null key always stay.
    Null and empty texts are equal texts. A text of fewer words than a shingle is one shingle. Other
    columns pass through. Empty input: no rows.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("key"), body.alias("text")).where("key IS NOT NULL")
    hashed = rows.select("key", *[h.alias(f"h{i}") for i, h in enumerate(text_key("text"))], "text")
    copies = materialize(hashed.drop("text"), "keep-copies")
    firsts = copies.groupBy("h0", "h1").agg(F.min("key").alias("key")).withColumn("m", F.monotonically_increasing_id())
    firsts = materialize(firsts, "keep-firsts")
    repeated = copies.count() > copies.distinct().count()

    def texts(of: DataFrame) -> DataFrame:
        found = hashed.join(of, ["key", "h0", "h1"])
        return found.dropDuplicates([c for c in ("m", "root") if c in of.columns]) if repeated else found

    groups = near_duplicates(rows.select(F.col("key").alias(key), F.col("text").alias(text)), None, bits, key, text, MOST_COPIES)
    groups = groups.select(F.col(key).alias("key"), F.col("component_id").alias("root")).distinct()
    reps = materialize(firsts.join(groups, "key"), "keep-reps")
    leaders = materialize(reps.groupBy("root").agg(F.min(F.struct("key", "m")).alias("l"), F.count("*").alias("n")).where("n > 1").select("root", F.col("l.m").alias("src")), "keep-leaders")
    stars = materialize(reps.join(leaders, "root").where("m <> src").select("src", F.col("m").alias("dst")), "keep-stars")
    found = agreeing(stars, texts, reps.select("key", "h0", "h1", "m"), words, similarity, likely=True)
    member = materialize(connected_components(found), "keep-components")
    parts = firsts.join(member, F.col("m") == F.col("node"), "left").select("key", "h0", "h1", "m", F.coalesce("component", "m").alias("part"))
    parts = materialize(parts, "keep-parts")
    found = found.unionByName(prefix_links(texts, parts, words, similarity))
    member = materialize(connected_components(found), "keep-components")
    named = firsts.join(member, F.col("m") == F.col("node")).select("key", "h0", "h1", "component")
    least = materialize(named.groupBy("component").agg(F.min("key").alias("stays")), "keep-least")
    near = named.join(least, "component").where("key <> stays").select("h0", "h1", F.lit(True).alias("near"))
    # a text that goes takes all its copies along
    fate = materialize(firsts.select("h0", "h1", F.col("key").alias("first")).join(materialize(near, "keep-near"), ["h0", "h1"], "left"), "keep-fate")
    lost = copies.join(fate, ["h0", "h1"]).where("near OR key <> first").select("key", "h0", "h1").distinct()
    lost = materialize(lost, "keep-lost").toDF("_bw_key", "_bw_h0", "_bw_h1")
    h0, h1 = text_key(body)
    return df.join(lost, (F.col(f"`{key}`") == F.col("_bw_key")) & (h0 == F.col("_bw_h0")) & (h1 == F.col("_bw_h1")), "left_anti")


def digest(documents: DataFrame) -> DataFrame:
    out = near_duplicates(documents)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
