"""Windows of reads as numbers: two bits a symbol, whole batches at a time. These run inside tasks, on Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Symbols of a word of a packed k-mer, so that a word is never negative as a long.
WORD = 31
#: Windows that are worked on at a time: their arrays fit in a core's cache.
BLOCK = 1 << 17
#: Bytes of texts that are worked on at a time: a batch of long texts may hold many times that.
PART = 1 << 21
FOREIGN = 4

_CODE = np.full(256, FOREIGN, dtype=np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def word_sizes(k: int) -> list[int]:
    """Symbols of each word of a packed k-mer."""
    return [min(WORD, k - at) for at in range(0, k, WORD)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts in a row, one byte a character (of several only the first), and where each text begins (one more: the end). Null: empty."""
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[ends[0] : ends[-1]] if held is not None and ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    if len(data) and data.max() >= 128:
        first = (data & 0xC0) != 0x80
        ends = np.concatenate([[0], np.cumsum(first)])[ends]
        data = data[first]
    return data, ends


def parts(batch: pa.RecordBatch, column: int = 0, most: int = PART) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of rows that hold ``most`` bytes of a column of texts, or one text each: what is made of them grows with neither batch nor table."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Reads:
    """The symbols of a column of reads in a row, a foreign one between any two. Read r begins at ``starts[r]``."""

    def __init__(self, column: pa.Array):
        data, ends = text_bytes(column)
        self.sizes = np.diff(ends)
        self.starts = ends[:-1] + np.arange(len(ends) - 1)
        self.code = np.insert(_CODE[data], ends[1:], FOREIGN)

    def read_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1

    def blocks(self, k: int, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
        """(place, symbols): stretches of ``size`` windows, each with the k - 1 symbols that the last one needs."""
        for at in range(0, len(self.code) - k + 1, size):
            yield at, self.code[at : at + size + k - 1]


def sound(code: np.ndarray, k: int) -> np.ndarray:
    """Where windows of k symbols begin that hold no foreign one."""
    bad = np.concatenate([[0], np.cumsum(code == FOREIGN)])
    return np.flatnonzero(bad[k:] == bad[:-k])


def _runs(code: np.ndarray, m: int, turned: bool) -> np.ndarray:
    """For each place the m symbols from there as a number to base 4, or those of the reverse complement: runs of 1, 2, 4, ... put together."""
    one = (3 - (code & 3) if turned else code & 3).astype(np.uint64)
    made, size, out, done = one, 1, None, 0
    left = m
    while left:
        if left & 1:
            if out is None:
                out, done = made, size
            else:
                low, high = (out, made[done:]) if turned else (made[done:], out)
                n = min(len(made) - done, len(out))
                low, high = low[:n], high[:n]
                out = high << np.uint64(2 * (done if turned else size)) | low
                done += size
        left >>= 1
        if left:
            n = len(made) - size
            low, high = (made[:n], made[size:]) if turned else (made[size:], made[:n])
            made = high << np.uint64(2 * size) | low
            size *= 2
    return out


def forward(code: np.ndarray, k: int) -> list[np.ndarray]:
    """The words of the k-mer at each place."""
    n, at, made = len(code) - k + 1, 0, {}
    out = []
    for m in word_sizes(k):
        made[m] = made[m] if m in made else _runs(code, m, False)
        out.append(made[m][at : at + n])
        at += m
    return out


def backward(code: np.ndarray, k: int) -> list[np.ndarray]:
    """The words of the reverse complement of the k-mer at each place."""
    n, at, made = len(code) - k + 1, 0, {}
    out = []
    for m in word_sizes(k):
        made[m] = made[m] if m in made else _runs(code, m, True)
        begin = k - at - m
        out.append(made[m][begin : begin + n])
        at += m
    return out


def before(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Where the words of ``a`` come before those of ``b`` or equal them."""
    less = a[-1] <= b[-1]
    for x, y in zip(a[-2::-1], b[-2::-1]):
        less = (x < y) | ((x == y) & less)
    return less


def canonical_words(code: np.ndarray, k: int, order: str = "ACGT") -> tuple[list[np.ndarray], np.ndarray]:
    """The lesser of each place's k-mer and its reverse complement, where symbols are ordered as in ``order``; and whether that is the k-mer itself."""
    there, back = forward(code, k), backward(code, k)
    if order == "ACGT":
        own = before(there, back)
    else:
        # complements of symbols in another order are not 3 minus them, so both strands are numbered one by one
        rank = np.array([order.index(c) for c in "ACGT"] + [FOREIGN], dtype=np.uint8)
        other = np.array([order.index(c) for c in "TGCA"] + [FOREIGN], dtype=np.uint8)
        own = before(forward(rank[code], k), _reversed(other[code], k))
    return [np.where(own, x, y) for x, y in zip(there, back)], own


def _reversed(code: np.ndarray, k: int) -> list[np.ndarray]:
    """The words of the k symbols at each place, last one first."""
    return [w[::-1] for w in forward(code[::-1], k)]


def mixed(words: list[np.ndarray]) -> np.ndarray:
    """A number that equal k-mers share."""
    h = words[0]
    for w in words[1:]:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w
    return h


def tallied(words: list[np.ndarray], weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal k-mers once, with how often they occur or the sum of their weights. A k-mer of several words may be left twice, which the shuffle settles."""
    if not len(words[0]):
        return words, np.zeros(0, dtype=np.int64 if weight is None else np.float64)
    if len(words) == 1 and weight is None:
        key, times = np.unique(words[0], return_counts=True)
        return [key], times
    order = np.argsort(mixed(words), kind="stable")
    words = [w[order] for w in words]
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order))) if weight is None else np.add.reduceat(weight[order], first)
    return [w[first] for w in words], times


def same_read(reads: Reads, place: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` symbols from each place are of one read."""
    return reads.read_of(place) == reads.read_of(place + width - 1)


@cache
def norms(p: int) -> np.ndarray:
    """Of each p-mer's number its own or its reverse complement's, the lesser of those allowed; 4^p if neither is.

    Not allowed is what begins with ACA, ends in TGT or in TT and any symbol, or holds AA after its first symbol.
    """
    x = np.arange(4**p, dtype=np.int64)
    digit = [x >> 2 * (p - 1 - i) & 3 for i in range(p)]
    bad = (digit[0] == 0) & (digit[1] == 1) & (digit[2] == 0)
    bad |= (digit[-3] == 3) & (digit[-2] == 2) & (digit[-1] == 3)
    bad |= (digit[-3] == 3) & (digit[-2] == 3)
    for i in range(1, p - 1):
        bad |= (digit[i] == 0) & (digit[i + 1] == 0)
    back = sum((3 - d) << 2 * i for i, d in enumerate(digit))
    own = np.where(bad, 4**p, x)
    return np.minimum(own, own[back])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: of runs of 1, 2, 4, ... of them, and two that overlap."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def signatures(code: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of k symbols begin, and the least norm of each one's p-mers. Each p-mer's norm is looked up once."""
    at = sound(code, k)
    norm = norms(p)[forward(code, p)[0].view(np.int64)]
    return at, sliding_least(norm, k - p + 1)[at]


def wide_signatures(code: np.ndarray, k: int, p: int) -> np.ndarray:
    """For each place the least hash of its window's p-mers (31 symbols at most), of each the lesser of it and its reverse complement. Places of no window have a number too."""
    h = canonical_words(code, p)[0][0] * np.uint64(0x9E3779B97F4A7C15)
    return sliding_least((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), k - p + 1)


def side_by_side(code: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of symbols one after the other, a foreign one behind each."""
    step = size + 1
    each = np.arange(step.sum()) - np.repeat(np.cumsum(step) - step, step)
    out = code[np.minimum(np.repeat(place, step) + each, len(code) - 1)]
    out[np.cumsum(step) - 1] = FOREIGN
    return out


def runs(reads: Reads, k: int, p: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, windows, signature) of maximal runs of neighbouring windows with one signature, a block's at a time. A run goes on over blocks."""
    open_: tuple[int, int, int] | None = None
    for begin, code in reads.blocks(k):
        at, signature = signatures(code, k, p)
        if not len(at):
            continue
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (signature[1:] != signature[:-1])]))
        place, n, signature = at[first] + begin, np.diff(np.append(first, len(at))), signature[first]
        if open_:
            if place[0] == open_[0] + open_[1] and signature[0] == open_[2]:
                place[0], n[0] = open_[0], n[0] + open_[1]
            else:
                yield tuple(np.array([x]) for x in open_)
        open_ = int(place[-1]), int(n[-1]), int(signature[-1])
        if len(place) > 1:
            yield place[:-1], n[:-1], signature[:-1]
    if open_:
        yield tuple(np.array([x]) for x in open_)


def cut(place: np.ndarray, n: np.ndarray, signature: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in parts of ``most`` windows, the last one of what is left."""
    parts = -(-n // most)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(place, parts) + number * most, np.minimum(np.repeat(n, parts) - number * most, most), np.repeat(signature, parts)


def squeezed(code: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of symbols, four a byte, one after the other; and the bytes that each takes."""
    held = -(-size // 4)
    out = np.zeros(4 * held.sum(), dtype=np.uint8)
    each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(4 * (np.cumsum(held) - held), size) + each] = code[np.repeat(place, size) + each]
    four = out.reshape(-1, 4)
    return four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3], held


def spread(packed: np.ndarray) -> np.ndarray:
    """The symbols of bytes, four each."""
    return np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).reshape(-1)
