"""Words of whole texts as 64-bit numbers, in chunks of bounded size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words that a chunk holds, about (a longer text is a chunk of its own), and bytes that are split at a time.
CHUNK_WORDS, PIECE_BYTES = 150_000, 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def split(text: str | bytes | None) -> list[bytes]:
    """What stands between the six ASCII white characters; null: none."""
    return (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).split()


def hashes(text: bytes | None, lower: bool = False) -> np.ndarray:
    """XXH64 of each word of a text, which is split a piece at a time."""
    found, at, n = [], 0, len(text or b"")
    while at < n:
        cut = _WHITE.search(text, at + PIECE_BYTES) if at + PIECE_BYTES < n else None
        end = cut.start() if cut else n
        piece = text[at:end] if at or end < n else text
        words = (piece.lower() if lower else piece).split()  # of bytes: A-Z and the six white characters
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)))
        at = end
    return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, dtype=np.uint64), *found])


def wide_hashes(text: bytes | None, lower: bool = False) -> np.ndarray:
    """Two columns, the halves of XXH3's 128 bits of each word of a text, which is split a piece at a time."""
    found, at, n = [np.zeros((0, 2), dtype=np.uint64)], 0, len(text or b"")
    while at < n:
        cut = _WHITE.search(text, at + PIECE_BYTES) if at + PIECE_BYTES < n else None
        end = cut.start() if cut else n
        piece = text[at:end] if at or end < n else text
        words = (piece.lower() if lower else piece).split()
        found.append(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=np.uint64).reshape(-1, 2))
        at = end
    return found[1] if len(found) == 2 else np.concatenate(found)


#: Words of more bytes are numbered one by one.
_LONG = 64
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: The lowest 0 to 8 bytes of a number.
_LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def _numbers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of texts in a row, eight bytes at a time for all words at once, and how many words end before each of ``ends``."""
    held = np.append(data, np.zeros(8, dtype=np.uint8))
    inside = ~_IS_WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=held, strides=(1,))
    size = last - first
    made = mix((eight[first] & _LOWEST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for at in range(8, _LONG, 8):
        more = np.flatnonzero(size > at)
        if not len(more):
            break
        made[more] = mix(made[more] * np.uint64(0x9E3779B97F4A7C15) + (eight[first[more] + at] & _LOWEST[np.minimum(size[more] - at, 8)]))
    for i in np.flatnonzero(size > _LONG).tolist():
        made[i] = xxhash.xxh64_intdigest(data[first[i] : last[i]])
    return made, np.searchsorted(last, ends, side="right")


def numbers(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text numbers of its words: equal words have equal ones, others hardly ever. About PIECE_BYTES are looked at at a time."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE_BYTES, side="right")) - 1)
        whole = b"".join(texts.slice(at, end - at).to_pylist())
        if end == at + 1 and len(whole) > PIECE_BYTES:
            found, begun = [np.zeros(0, dtype=np.uint64)], 0
            while begun < len(whole):
                cut = _WHITE.search(whole, begun + PIECE_BYTES)
                stop = cut.start() if cut else len(whole)
                piece = np.frombuffer(whole, dtype=np.uint8, count=stop - begun, offset=begun)
                found.append(_numbers(piece, np.array([len(piece)]))[0])
                begun = stop
            yield np.concatenate(found)
        else:
            made, upto = _numbers(np.frombuffer(whole, dtype=np.uint8), ends[at + 1 : end + 1] - ends[at])
            yield from np.split(made, upto[:-1])
        at = end


def chunks(batches: Iterator[pa.RecordBatch], text: int, lower: bool = False, most: int = CHUNK_WORDS, wide: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows without their text, the hashes of all their words in a row (``wide``: of 128 bits), and where each row's begin (one more: the end).

    A chunk goes on over batches until it has ``most`` words.
    """
    one = wide_hashes if wide else hashes
    return _chunks(batches, text, most, lambda texts: (one(t.as_py(), lower) for t in texts.cast(pa.large_binary())))


def numbered_chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = CHUNK_WORDS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """:func:`chunks` with :func:`numbers` for hashes."""
    return _chunks(batches, text, most, numbers)


def _chunks(batches: Iterator[pa.RecordBatch], text: int, most: int, of: Callable[[pa.Array], Iterator[np.ndarray]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    rows: list[pa.RecordBatch] = []
    words: list[np.ndarray] = []
    held = 0

    def made() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0] if len(rows) > 1 else rows[0]
        return whole, np.concatenate(words), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)

    for b in batches:
        if not b.num_rows:
            continue
        rest = b.select([i for i in range(b.num_columns) if i != text])
        first = 0
        for at, made_of in enumerate(of(b.column(text))):
            words.append(made_of)
            held += len(words[-1])
            if held >= most:
                rows.append(rest.slice(first, at + 1 - first))
                yield made()
                first, held = at + 1, 0
                rows.clear()
                words.clear()
        if first < b.num_rows:
            rows.append(rest.slice(first))
    if rows:
        yield made()
