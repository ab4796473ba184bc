import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import common, embed_dedup, kdtree, simhash

DOCS = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("at_once", [0, 1 << 20])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "EDGES_PER_TASK", at_once)
    draw = random.Random(4)
    edges = [(draw.randint(0, 120), draw.randint(0, 120)) for _ in range(90)] + [(5, 5)] + [(1000, i) for i in range(200, 400)] + [(i, i + 1) for i in range(500, 560)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    lonely = {x for x in parent if find(x) == x and not any(find(y) == x for y in parent if y != x)}
    assert got == {x: find(x) for x in parent if x not in lonely}
    assert common.connected_components(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0


@pytest.mark.parametrize("bits,n", [(0, 300), (4, 600), (7, 400)])
def test_trie_walk_is_complete(bits, n):
    draw = np.random.default_rng(bits)
    x = draw.integers(0, 1 << 64, n, dtype=np.uint64)
    near = x[: n // 2].copy()
    for _ in range(5):
        near ^= np.uint64(1) << draw.integers(0, 64, len(near), dtype=np.uint64)
    x = np.concatenate([x, near, near[:20]])
    group = np.concatenate([np.zeros(n, dtype=np.int64), np.zeros(len(near), dtype=np.int64), np.ones(20, dtype=np.int64)])
    src, dst = simhash.group_links(group, x, bits)
    parent = {int(v): int(v) for v in x}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in zip(src.tolist(), dst.tolist()):
        parent[find(a)] = find(b)
    want = {int(v): int(v) for v in x}

    def root(a):
        while want[a] != a:
            a = want[a]
        return a

    for g in (0, 1):
        y = np.unique(x[group == g])
        i, j = np.nonzero(np.bitwise_count(y[:, None] ^ y[None, :]) <= bits)
        for a, b in zip(y[i].tolist(), y[j].tolist()):
            want[root(a)] = root(b)
    groups = {}
    for v in parent:
        groups.setdefault(find(v), set()).add(v)
    expected = {}
    for v in want:
        expected.setdefault(root(v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_dense_ball_is_one_group():
    x = np.array([1 << i | 1 << j for i in range(64) for j in range(i)], dtype=np.uint64)
    src, dst = simhash.group_links(np.zeros(len(x), dtype=np.int64), x, 4)
    assert len(src) == len(x) - 1 and len(set(dst.tolist())) == 1


def test_simhash_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (4, "a b"), (None, "A B"), (5, "alpha " * 5000), (6, "one two three four five six")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[1].fp == 0 and by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[4].component_id == 4 and by[None].component_id == 4
    assert simhash.near_duplicates(docs(spark, rows).where("false")).count() == 0


def test_simhash_query_against_plain_python(spark):
    import xxhash

    draw = random.Random(12)
    vocabulary = ["".join(draw.choices("abcdé", k=draw.randint(1, 5))) for _ in range(200)]
    rows = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 2, 3, 4, 5, 60, 300])))) for i in range(120)]
    for i in range(120, 200):
        words = (rows[draw.randrange(120)][1] or "").split()
        if len(words) > 50:
            words[draw.randrange(len(words))] = "Other"
        rows.append((i, draw.choice([" ", "\n\t"]).join(words)))
    rows += [(300, None), (301, " "), (302, "A B c D e"), (303, "a b C d E"), (304, "w " * 30_000), (304, "w " * 30_000)]

    def plain(t):
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [plain(t) for _, t in rows]
    least = [i for i, _ in rows]
    while True:
        now = [min(least[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(rows))]
        if now == least:
            break
        least = now
    got = sorted(tuple(r) for r in simhash.digest(docs(spark, rows)).collect())
    assert got == sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, least))


def test_large_groups_are_split_without_loss(spark, monkeypatch):
    draw = random.Random(2)
    base = draw.getrandbits(64)
    x = sorted({base ^ (1 << draw.randrange(20)) ^ (1 << draw.randrange(20)) for _ in range(150)} | {draw.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in x], "fp long")
    whole = {tuple(sorted((r.node, r.component))) for r in common.connected_components(simhash.links(df, len(x), 4)).collect()}
    monkeypatch.setattr(simhash, "GROUP_ROWS", 10)
    assert {tuple(sorted((r.node, r.component))) for r in common.connected_components(simhash.links(df, len(x), 4)).collect()} == whole


def test_keep_one(spark):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(3000)]
    text = lambda: [draw.choice(words) for _ in range(300)]
    rows, near = [], []
    for i in range(25):
        t = text()
        rows.append((2 * i, " ".join(t)))
        if i % 2:
            t[draw.randrange(300)] = "changed"
            t[draw.randrange(300)] = "altered"
            rows.append((2 * i + 1, " ".join(t)))
            near.append(2 * i + 1)
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, ""), (1003, None), (None, rows[0][1])]
    df = docs(spark, rows).withColumn("component_id", F.lit("own")).withColumn("key", F.lit(1))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda v: (v is None, v))
    assert ids == [*sorted(i for i, _ in rows[:-5] if i not in near), 1002, None]
    assert simhash.keep_one(df.where("false")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_keep_one_misses_no_pair(spark, monkeypatch, small):
    """Copies that SimHash sets far apart: a long token more, words put before or behind, cut off, replaced in a block."""
    if small:
        monkeypatch.setattr(simhash, "PAIR_ROWS", 2)
        monkeypatch.setattr(simhash, "VERIFY_ROWS", 3)
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(3000)]
    some = lambda n: [draw.choice(words) for _ in range(n)]
    token = lambda n: "".join(draw.choices("klmnopqrst", k=n))
    texts = []
    for n in (6, 25, 40, 100, 300):
        for share in (0.05, 0.1, 0.15, 0.19, 0.24, 0.3):
            t, k = some(n), max(1, int(n * share))
            at = draw.randrange(n - k + 1)
            texts += [t, [*t, *some(k)], [*some(k), *t], t[: n - k], [*t[:at], *some(k), *t[at + k :]], [*t, token(60)]]
    t = some(40)
    texts += [[*t, token(60)] for _ in range(12)] + [[token(60), *t[4:]] for _ in range(3)]
    passage = some(15)
    texts += [[*some(30), *passage, *some(30)] for _ in range(10)]
    draw.shuffle(texts)
    sets = [{" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = simhash.keep_one(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


VECTORS = "vec_id long, embedding array<float>, label int, score string"


def vectors(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(120, 6)).astype(np.float32)
    x[60:90] = x[:30] + draw.normal(scale=0.05, size=(30, 6)).astype(np.float32)
    x[90:] = x[5]
    rows = [(i, v.tolist(), i % 3 if i < 90 else 1, "s") for i, v in enumerate(x)]
    rows += [(200, None, 1, "s"), (201, [], 1, "s"), (202, [0.0] * 6, 1, "s"), (203, [1.0, float("nan")] + [0.0] * 4, 1, "s"), (204, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1, "s"), (205, x[0].tolist(), None, "s"), (206, [float("inf")] * 6, 1, "s"), (207, [1.0, 2.0], 1, "s"), (3, x[3].tolist(), 0, "s")]
    return rows, spark.createDataFrame(rows, VECTORS)


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(kdtree, "SHARD_ROWS", 20)
        monkeypatch.setattr(kdtree, "BLOCK_ROWS", 5)
        monkeypatch.setattr(kdtree, "LEAF_ROWS", 3)
    rows, df = vectors(spark)
    ok = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, _, _ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for i, q in sorted({(i, tuple(q)) for i, q in ok if i % 20 == 0}):
        best = sorted((-sum(a * b for a, b in zip(q, p)), j) for j, p in ok if j != i and len(p) == len(q))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, kdtree.top_k(df, F.col("vec_id") % 20 == 0).collect())) == sorted(want)


def test_top_k_few_and_large(spark):
    df = spark.createDataFrame([(0, [1e12, -1e12]), (1, [1e-3, 0.0]), (2, [2.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, kdtree.top_k(df, F.col("vec_id") == 0).collect()))
    big = 256 * 10**12
    assert got == [(0, 1, 2, 512 * big - 256 * big), (0, 2, 1, 0)]
    huge = spark.createDataFrame([(0, [1e15]), (1, [1e15]), (2, [2e15])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, kdtree.top_k(huge, F.col("vec_id") == 0).collect())) == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, (1 << 63) - 1)]
    assert kdtree.top_k(df.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_embedding_dedup(spark, monkeypatch, small):
    if small:
        for name, size in (("CELL_BYTES", 300), ("BLOCK_BYTES", 200), ("HELD_BYTES", 100), ("STRIP_ROWS", 2)):
            monkeypatch.setattr(embed_dedup, name, size)
    rows, df = vectors(spark)
    usable = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and lab is not None for _, v, lab, _ in rows]
    n = len(rows)
    link = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            if i != j and usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (i, j))
                link[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    comp = [r[0] for r in rows]
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
    want = sorted((rows[i][0], int(link[i].sum()), comp[i], rows[i][0] == comp[i]) for i in range(n))
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect())) == want
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_cells_lose_no_partner():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(1500, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = embed_dedup.spherical_kmeans(x, 12)
    home, cosine = embed_dedup.nearest(x, centres)
    least = np.array([cosine[home == c].min() if (home == c).any() else 1.0 for c in range(12)])
    met = set(zip(*(v.tolist() for v in embed_dedup.meeting(centres, least, 0.93))))
    i, j = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert all((min(a, b), max(a, b)) in met for a, b in zip(home[i].tolist(), home[j].tolist()))
    far = np.eye(40)  # cells of one vector each, at right angles
    assert len(embed_dedup.meeting(far, np.ones(40), 0.93)[0]) == 40


def test_fit_of_many_centres_is_bounded(monkeypatch):
    """What the products of vectors and centres take at a time does not grow with both."""
    monkeypatch.setattr(embed_dedup, "HELD_BYTES", 1 << 20)
    x = np.random.default_rng(2).normal(size=(8192, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    centres = embed_dedup.spherical_kmeans(x, 512, rounds=2)
    home, _ = embed_dedup.nearest(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20 and (home == (x @ centres.T).argmax(axis=1)).mean() > 0.999


def test_top_k_of_whole_numbers_beyond_doubles(spark):
    """Scores between 2^52 and 2^63 are exact, and a tree finds them."""
    draw = random.Random(4)
    rows = [(i, [float(draw.randint(-(1 << 20), 1 << 20)) for _ in range(3)]) for i in range(400)]
    rows += [(400, [float(1 << 30), 1.0, 0.0]), (401, [float(1 << 30), 1.0, 0.0]), (402, [1e300, -1e300, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, kdtree.top_k(df, F.col("vec_id") % 100 == 0).collect()))
    whole = [(i, [int(np.floor(256 * c)) if abs(c) < 1e200 else int(256 * c) for c in v]) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 100 == 0:
            best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, p)))), j) for j, p in whole if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_candidates_cost_few_copies():
    assert simhash.affordable(10**5, 7, 64) == 7 and simhash.affordable(10**9, 7, 64) < 7
    for n in (10, 10**6, 10**9, 10**12):
        bits = simhash.affordable(n, 7, 64)
        assert len(simhash._masks(simhash.blocks_for(n, bits), bits)) <= 64 and bits > 2
