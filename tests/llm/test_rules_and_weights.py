"""Whitening, quality rules and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import quality, resample, whitening

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, component int, n string"


def texts_of(draw):
    vocabulary = ["".join(draw.choices("abcdeéZ", k=draw.randint(1, 6))) for _ in range(50)]
    text = lambda n: " ".join(draw.choice(vocabulary) + draw.choice(["", ".", "\n", "\n\n", "\t", " #$ ", "&&"]) for _ in range(n))
    rows = [(i, text(draw.choice([0, 1, 2, 3, 25, 80]))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " \n "), (73, "x " * 70), (74, "a b c " * 40), (75, text(30_000)), (76, rows[5][1]), (76, rows[5][1]), (None, text(40)), (None, text(30)), (77, "w" * 3_000_000 + " end"), (78, "  　ß ﬀ\n  \nK K K K")]
    return rows


# whitening


def whitened(spark, rows, dim):
    """By a whole eigendecomposition."""
    held = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in held], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    d = n * x - sums
    deviation = [(i, int((r * r).sum())) for (i, _), r in zip(held, d)]
    c = d.astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return held, deviation, c, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("dim,n", [(64, 400), (3, 50), (300, 900)])
def test_whitening(spark, dim, n):
    draw = np.random.default_rng(dim)
    mixed = draw.standard_normal((dim, dim)) * (0.97 ** np.arange(dim))[:, None] / 8
    rows = [(i, [float(v) for v in x]) for i, x in enumerate((draw.standard_normal((n, dim)) @ mixed))]
    rows += [(n, None), (n + 1, []), (n + 2, [None] * dim), (n + 3, [float("nan")] * dim), (n + 4, [float("inf")] + [0.0] * (dim - 1)), (n + 5, [0.5] * (dim + 1)), (3, rows[3][1]), (None, rows[4][1])]
    df = spark.createDataFrame([(i, v, 7, "own") for i, v in rows], VECTORS)
    held, deviation, c, values, vectors = whitened(spark, rows, dim)
    k = min(8, dim)
    got = whitening.digest(df).collect()
    assert len(got) == k * len(held) and {r.n for r in got} == {len(held)}
    assert sorted({(str(r.vec_id), r.deviation) for r in got}) == sorted({(str(i), v) for i, v in deviation})
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, j + 1) for i, _ in held for j in range(k))
    for j in range(k):
        share = {r.explained for r in got if r.component == j + 1}
        assert len(share) == 1 and abs(share.pop() / (values[j] / values.sum()) - 1) < 1e-9
        want = dict(zip([i for i, _ in held], c @ vectors[:, j] / math.sqrt(values[j])))
        mine = {r.vec_id: r.whitened for r in got if r.component == j + 1}
        sign = 1 if mine[0] * want[0] > 0 else -1
        assert max(abs(mine[i] - sign * want[i]) for i in want) < 1e-7
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_whitening_of_few_and_equal_vectors(spark):
    df = lambda rows: spark.createDataFrame([(i, v, 7, "own") for i, v in rows], VECTORS)
    assert whitening.digest(df([])).collect() == [] and whitening.digest(df([(1, None), (2, [])])).collect() == []
    assert whitening.digest(df([(i, [0.5, 0.25, 0.125]) for i in range(6)])).collect() == []  # no variance, no component
    line = whitening.digest(df([(i, [i / 4, i / 2, 1.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 5 and abs(line[0].explained - 1) < 1e-9
    huge = whitening.digest(df([(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [0.0, 3.0])])).collect()
    assert {r.component for r in huge} >= {1} and max(r.deviation for r in huge) == (1 << 63) - 1


def test_whitening_restarts(spark, monkeypatch):
    """A search space much smaller than the vectors, so that blocks are dropped on the way."""
    monkeypatch.setattr(whitening, "BASIS", 72)
    draw = np.random.default_rng(5)
    x = draw.standard_normal((600, 200)) * (0.9 ** np.arange(200))
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, "") for i, v in enumerate(x)], VECTORS)
    model = whitening.fit(df)
    _, _, c, values, vectors = whitened(spark, [(i, [float(a) for a in v]) for i, v in enumerate(x)], 200)
    assert 2 < model.passes < 40 and np.abs(model.values / values[:8] - 1).max() < 1e-9
    assert (1 - np.abs((model.vectors * vectors[:, :8]).sum(axis=0))).max() < 1e-9


# quality rules


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_rules(spark):
    rows = texts_of(random.Random(12))
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], "doc_id long, text string, kept string, n_words int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (75, None), (3, 0)], "doc_id long, quality int")
    got = quality.digest(docs, labels).collect()
    assert Counter((r.doc_id, *[r[c] for c in quality.COUNTS], r.base_failed) for r in got) == Counter((i, *rules(t)) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and sorted(str(r.doc_id) for r in good.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality.digest(docs.where("false"), labels).count() == 0
    unlabelled = quality.digest(docs, labels.where("false")).collect()
    assert all(r.kept != r.base_failed for r in unlabelled)


def test_texts_in_pieces(monkeypatch):
    texts = [t.encode() for _, t in texts_of(random.Random(3)) if t and len(t) < 100_000]
    whole = [quality.measure(t) for t in texts], [Counter(resample.buckets_of(t)[0].tolist()) for t in texts]
    monkeypatch.setattr(quality, "PIECE_BYTES", 7)
    monkeypatch.setattr(resample, "PIECE_BYTES", 7)
    assert whole == ([quality.measure(t) for t in texts], [Counter(resample.buckets_of(t)[0].tolist()) for t in texts])


def test_trees_separate_and_go_with_their_signs():
    draw = np.random.default_rng(1)
    x = draw.random((4000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * draw.standard_normal(4000)) < 0.6).astype(float)
    t = quality.fit_trees(x[:3000], y[:3000], (-1, 0, 0))
    assert ((t.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    up = x[3000:].copy()
    up[:, 0] += draw.random(1000)
    assert (t.score(up) <= t.score(x[3000:]) + 1e-12).all()
    row = lambda i, v: t.value[i] if t.left[i] == i else row(t.left[i] if v[t.feature[i]] <= t.threshold[i] else t.right[i], v)
    want = [1 / (1 + math.exp(-(t.base + sum(row(r, v) for r in t.roots)))) for v in x[:50]]
    assert np.allclose(t.score(x[:50]), want)


def test_rules_learn_what_the_labels_say(spark):
    """On labelled rows that the fit has not seen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    held = F.col("doc_id") % 3 == 1
    model = quality.fit(docs, labels.where(~held))
    rows = quality.judged(docs.join(labels.where(held), "doc_id"), model).select("quality", "kept", "base_failed").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) > 0.97 * len(good) and sum(r.kept for r in bad) < 0.1 * len(bad)


# importance resampling


def importance(docs, items, percent=5):
    def features(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))

    made = [(i, *features(t)) for i, t in docs]
    s, t = sum((f for *_, f in made), Counter()), sum((features(x)[1] for x in items), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    rows = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(c * gain[b] for b, c in f.items())
        rows.append((i, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    most = percent * len(able) // 100
    return rows, able[:most]


def test_resampling(spark, monkeypatch):
    rows = texts_of(random.Random(8))
    items = [rows[9][1], None, "", "a b c d e", rows[75 - 75][1], "é " * 30]
    schema = "doc_id long, text string, score string, rank int"
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], schema)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    want, drawn = importance(rows, items, 30)
    key = lambda rows: Counter((r[0], r[2], r[3], r[4]) for r in rows)
    for chunk, slices in ((450_000, 64), (300, 2)):  # many chunks, many slices
        monkeypatch.setattr(resample, "CHUNK_FEATURES", chunk)
        monkeypatch.setattr(resample, "SLICE_CHUNKS", slices)
        got = resample.importance(docs, target, percent=30).collect()
        assert Counter((r.key, r.n_features, r.weight, r.score) for r in got) == key(want)
        ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [(r.key, r.score) for r in ranked] == [(d[0], d[4]) for d in drawn]
    out = resample.resample(docs, target, percent=30)
    assert set(out.columns) == {"doc_id", "text", "weight", "score", "rank"}
    by_key = {}
    for i, t in rows:
        by_key.setdefault(i, set()).add(t)
    kept = out.collect()
    assert sorted(r["rank"] for r in kept) == list(range(1, len(drawn) + 1)) and all(r.text in by_key[r.doc_id] for r in kept)
    assert resample.digest(docs.where("false"), target).count() == 0
    assert Counter((r.doc_id, r.weight) for r in resample.digest(docs, target.where("false")).collect()) == Counter((r[0], r[3]) for r in importance(rows, [])[0])


def test_ties_go_to_the_lesser_key(spark):
    """No features in common with anything: weights are equal, noise decides, then the key."""
    docs = spark.createDataFrame([(i % 7, "w " * 25) for i in range(140)], "doc_id long, text string")
    got = resample.digest(docs, spark.createDataFrame([(1, "w")], "item_id long, text string")).collect()
    ranked = sorted((r["rank"], r.score, r.doc_id) for r in got if r["rank"])
    assert [r[0] for r in ranked] == list(range(1, 8)) and [r[1:] for r in ranked] == sorted((r[1:] for r in ranked), key=lambda x: (-x[0], x[1]))
