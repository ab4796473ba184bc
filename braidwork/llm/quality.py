"""Quality rules: gradient-boosted trees over statistics of documents, flattened into node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

#: Labelled rows that a fit sees at most, the least by a hash of doc_id: the documented bound of the sample.
TRAIN_ROWS = 24_000
#: Bytes of a text that are split at a time.
PIECE_BYTES = 1 << 20
#: A document is kept if its score is this at least.
THRESHOLD = 0.5
#: What every document must have, and the share of its words that may stand in repeated windows, in hundredths.
LEAST_WORDS, MOST_REPEATED = 50, 50

#: The statistics that the trees see, and how a score may go with each: never up where it rises (-1), never down (1), or either way (0).
FEATURES = {
    "log_words": 0,
    "word_chars": 0,
    "symbols_a_word": -1,
    "signs_a_word": 0,
    "digit_share": 0,
    "capital_share": 0,
    "beyond_ascii_share": 0,
    "repeated_share": -1,
    "repeated_lines": -1,
    "distinct_share": 0,
    "commonest_share": -1,
    "words_a_line": 0,
    "longest_word": 0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_ALL = bytes(range(256))
_of = lambda keep: bytes(c for c in _ALL if c not in keep)  # noqa: E731  what to leave out so that only ``keep`` is left
_SYMBOLS = _of(b"#*$%&|<>")
_SIGNS = _of(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_DIGITS, _CAPITALS, _LETTERS = _of(b"0123456789"), _of(bytes(range(65, 91))), _of(bytes([*range(65, 91), *range(97, 123)]))
_LEADING, _BEYOND = _of(bytes(range(192, 256))), _of(bytes(range(128, 256)))


def _left(text: bytes, leave_out: bytes) -> int:
    return len(text.translate(None, leave_out))


def word_numbers(text: bytes) -> tuple[np.ndarray, int]:
    """Each word's number, equal words equal ones, and the most bytes of a word; a text is split a piece at a time."""
    known: dict[bytes, int] = {}
    found, at, longest = [], 0, 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = (text[at:end] if at or end < len(text) else text).split()
        at = end
        if words:
            for w in set(words):
                if w not in known:
                    known[w] = len(known)
            longest = max(longest, max(map(len, words)))
            found.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64), longest


def repeated_words(u: np.ndarray, window: int = 3) -> int:
    """Words in windows that occur twice or more, the first one's too."""
    if len(u) < window:
        return 0
    code = u[: len(u) - window + 1]
    for i in range(1, window):  # numbers stay below the words' number squared
        code = code * (int(u.max()) + 1) + u[i : len(u) - window + 1 + i]
        if i < window - 1:
            _, code = np.unique(code, return_inverse=True)
    _, which, times = np.unique(code, return_inverse=True, return_counts=True)
    often = times[which] > 1
    covered = np.zeros(len(u), dtype=bool)
    for i in range(window):
        covered[i : len(often) + i] |= often
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a whole text; null: as of an empty one."""
    text = text or b""
    u, longest = word_numbers(text)
    n, symbols = len(u), _left(text, _SYMBOLS)
    ascii_white = len(text) - len(text.translate(None, b" \t\n\r\x0b\x0c"))
    beyond, leading = _left(text, _BEYOND), _left(text, _LEADING)
    chars = len(text) - ascii_white - beyond + leading
    seen: set[bytes] = set()
    lines, repeats = 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            repeats += line in seen
            seen.add(line)
    repeated = repeated_words(u)
    times = np.bincount(u) if n else np.zeros(1, dtype=np.int64)
    each, letters = max(n, 1), max(_left(text, _LETTERS), 1)
    features = [np.log1p(n), chars / each, symbols / each, (_left(text, _SIGNS) - symbols) / each, _left(text, _DIGITS) / max(chars, 1), _left(text, _CAPITALS) / letters, leading / max(chars, 1), repeated / each, repeats / max(lines, 1), (times > 0).sum() / each, times.max() / each, n / max(lines, 1), float(longest)]
    return [n, chars, symbols, repeats, repeated], [float(x) for x in features]


@dataclass(frozen=True)
class Trees:
    """All trees' nodes in a row. A leaf leads to itself; ``roots`` are the trees' first nodes, ``depth`` the steps to any leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features: all rows go down all trees at once."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth if len(self.roots) else 0):
            low = x[row, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[node].sum(axis=1), -35, 35)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], trees: int = 120, depth: int = 3, rate: float = 0.15, l2: float = 1.0, least: float = 4.0, bins: int = 64) -> Trees:
    """Newton boosting of the logistic loss over histograms of binned features, level by level.

    A split on a feature with a sign must leave its sides' values in that order, and their middle bounds all values
    below it on either side; so a whole tree goes with the feature as its sign says. ``least`` is the curvature
    that either side of a split must have.
    """
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)] if n else [np.zeros(0)] * f
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, f), dtype=np.int64)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if n else 1 - 1e-6
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, score = [], np.full(n, base)
    sign = np.array(signs)[None, :, None]
    spread = code + np.arange(f) * bins  # (feature, bin) as one number
    for _ in range(trees if 0 < share < 1 and len(np.unique(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        first = len(nodes)
        roots.append(first)
        nodes.append([0, 0.0, first, first, 0.0])
        at, open_ = np.zeros(n, dtype=np.int64), [first]  # where each row is among the open nodes; -1: at a leaf
        bounds = {first: (-np.inf, np.inf)}
        nodes[first][4] = float(-g.sum() / (h.sum() + l2))
        where = np.full(n, first)
        for _level in range(depth):
            live = at >= 0
            if not open_ or not live.any():
                break
            cell = (at[live, None] * (f * bins) + spread[live]).reshape(-1)
            size = len(open_) * f * bins
            sum_g = np.bincount(cell, np.repeat(g[live], f), size).reshape(len(open_), f, bins)
            sum_h = np.bincount(cell, np.repeat(h[live], f), size).reshape(len(open_), f, bins)
            gl, hl = sum_g.cumsum(axis=2), sum_h.cumsum(axis=2)
            g0, h0 = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = g0 - gl, h0 - hl
            lo = np.array([bounds[o][0] for o in open_])[:, None, None]
            hi = np.array([bounds[o][1] for o in open_])[:, None, None]
            wl, wr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
            w0 = np.clip(-g0 / (h0 + l2), lo, hi)
            loss = lambda g_, h_, w_: g_ * w_ + 0.5 * (h_ + l2) * w_ * w_
            gain = loss(g0, h0, w0) - loss(gl, hl, wl) - loss(gr, hr, wr)
            gain = np.where((hl >= least) & (hr >= least) & (sign * (wr - wl) >= 0), gain, -np.inf)
            gain[:, :, -1] = -np.inf
            best = gain.reshape(len(open_), -1).argmax(axis=1)
            next_open, moves = [], {}
            for i, o in enumerate(open_):
                j, cut = divmod(int(best[i]), bins)
                if not gain[i, j, cut] > 1e-6 or cut >= len(edges[j]):
                    continue
                a = len(nodes)
                values = float(wl[i, j, cut]), float(wr[i, j, cut])
                nodes.append([0, 0.0, a, a, values[0]])
                nodes.append([0, 0.0, a + 1, a + 1, values[1]])
                nodes[o] = [j, float(edges[j][cut]), a, a + 1, nodes[o][4]]
                low, high = bounds[o]
                middle = sum(values) / 2
                s = signs[j]
                bounds[a] = (low, middle) if s > 0 else (middle, high) if s < 0 else (low, high)
                bounds[a + 1] = (middle, high) if s > 0 else (low, middle) if s < 0 else (low, high)
                moves[i] = (j, cut, a, len(next_open))
                next_open += [a, a + 1]
            to = np.full(n, -1)
            for i, (j, cut, a, place) in moves.items():
                rows = np.flatnonzero(at == i)
                high_side = (code[rows, j] > cut).astype(np.int64)
                where[rows] = a + high_side
                to[rows] = place + high_side
            at, open_ = to, next_open
        for node in nodes[first:]:
            node[4] *= rate
        score = score + np.array([node[4] for node in nodes])[where]
    made = np.array(nodes).reshape(-1, 5)
    return Trees(made[:, 0].astype(np.int64), made[:, 1], made[:, 2].astype(np.int64), made[:, 3].astype(np.int64), made[:, 4], np.array(roots, dtype=np.int64), depth, base)


def measured(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with COUNTS (``_bw_n``, an array) and FEATURES (``_bw_x``) of each row's whole text."""
    fields = [documents.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([n for n, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.float64()))], names=[*keep, "_bw_n", "_bw_x"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "_bw_n array<bigint>", "_bw_x array<double>"])
    return documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("_bw_text")).mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", **options) -> Trees:
    """Trees from at most TRAIN_ROWS of the labelled rows, fitted in one task of an executor.

    Rows with a null key or label teach nothing; of several labels of one key the lowest counts. Null and empty texts teach as
    texts without words, very long ones whole; rows that repeat teach once each. Labels of one kind, or none: no trees, and the
    base alone decides (without labels: all is kept). Other columns of either table do not matter.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_bw_key")).agg(F.min(label).cast("double").alias("_bw_y"))
    sample = known.orderBy(F.xxhash64("_bw_key"), "_bw_key").limit(TRAIN_ROWS)  # bounded by TRAIN_ROWS
    texts = documents.select(F.col(f"`{key}`").alias("_bw_key"), F.col(f"`{text}`").alias("_bw_words")).join(F.broadcast(sample), "_bw_key")
    rows = measured(texts, ["_bw_key", "_bw_y"], "_bw_words").select("_bw_key", "_bw_y", "_bw_x")

    def train(group: pa.Table) -> pa.Table:
        x = group["_bw_x"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        y = group["_bw_y"].to_numpy()
        order = np.lexsort((*x.T, group["_bw_key"].to_numpy()))
        t = fit_trees(x[order], y[order], tuple(FEATURES.values()), **options)
        release()
        held = pa.array([t.roots.tolist()], pa.list_(pa.int64()))
        return pa.table({"feature": [t.feature.tolist()], "threshold": [t.threshold.tolist()], "left": [t.left.tolist()], "right": [t.right.tolist()], "value": [t.value.tolist()], "roots": held, "depth": [t.depth], "base": [t.base]}, schema=pa.schema([*((n, pa.list_(pa.float64() if n in ("threshold", "value") else pa.int64())) for n in ("feature", "threshold", "left", "right", "value", "roots")), ("depth", pa.int64()), ("base", pa.float64())]))

    schema = "feature array<bigint>, threshold array<double>, left array<bigint>, right array<bigint>, value array<double>, roots array<bigint>, depth bigint, base double"
    made = rows.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(train, schema).first()  # one row: a few thousand nodes at most
    if made is None:
        return fit_trees(np.zeros((0, len(FEATURES))), np.zeros(0), tuple(FEATURES.values()))
    whole, real = (lambda c: np.array(made[c], dtype=np.int64)), (lambda c: np.array(made[c], dtype=np.float64))
    return Trees(whole("feature"), real("threshold"), whole("left"), whole("right"), real("value"), whole("roots"), made.depth, made.base)


def judged(documents: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``documents`` with COUNTS, ``base_failed``, ``quality_score`` and ``kept``, which replace columns of these names.

    A null text counts as empty, has no words and fails; very long texts are read whole; rows that repeat are judged alike.
    Other columns pass through. Empty input: no rows.
    """
    made = (*COUNTS, "base_failed", "quality_score", "kept")
    names = [c for c in documents.columns if c not in made]
    told = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found = [measure(t.as_py()) for t in b.column(len(names))]
            counts = np.array([n for n, _ in found], dtype=np.int64)
            score = told.value.score(np.array([x for _, x in found]))
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= THRESHOLD))], names=[*names, *made])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields if f.name in names]
    schema = ", ".join([*kinds, *(f"{c} long" for c in COUNTS), "base_failed boolean", "quality_score double", "kept boolean"])
    return documents.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("binary").alias("_bw_text")).mapInArrow(run, schema)


def keep_good(documents: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns as they were."""
    verdict = judged(documents.select(*[F.col(f"`{c}`").alias(f"_bw_own_{i}") for i, c in enumerate(documents.columns)]), fit(documents, labels, text=text), f"_bw_own_{documents.columns.index(text)}")
    return verdict.where("kept").select(*[F.col(f"_bw_own_{i}").alias(c) for i, c in enumerate(documents.columns)])


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(documents.select("doc_id", "text"), fit(documents, labels)).select("doc_id", *COUNTS, "base_failed", "kept", F.round("quality_score", 6).alias("quality_score"))
