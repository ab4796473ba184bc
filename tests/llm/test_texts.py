import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from braidwork.llm import exchange, katz, line_dedup, mixing, packing, recompress, sharding, toxicity, words
from braidwork.llm.common import discard, materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


def awkward(draw):
    """Nulls, empty and long texts, ties and repeated rows."""
    vocabulary = ["".join(draw.choices("abcdeé", k=draw.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(draw.choice(vocabulary) + draw.choice(["", ".", "\n", "\n\n", "\t"]) for _ in range(n))
    rows = [(i, text(draw.choice([0, 1, 3, 30, 80])), f"src{i % 4}") for i in range(40)]
    shared = text(45)
    rows += [(50 + i, text(i) + " " + shared + "\n" + text(3 * i), "src0") for i in range(6)]
    rows += [(60, None, None), (61, "", "src1"), (62, " \n ", "src1"), (63, "x " * 70, "src1"), (64, "a b c " * 40, "src1"), (65, text(4000), "src2"), (66, shared, "src2"), (67, shared, "src2"), (68, shared, "src2")]
    return rows


def test_word_hashes_are_words():
    import pyarrow as pa

    texts = ["a b  c", None, "", "A\x0bb\x1cc", "é x y", "end", "a" * 100 + " z"]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]).slice(0)
    got = {}
    for _, w, ends in words.chunks(iter([b]), 0):
        split = [x for t in texts for x in words.split(t)]
        assert len(w) == len(split) and [len(words.split(t)) for t in texts] == np.diff(ends).tolist()
        for h, x in zip(w.tolist(), split):
            assert got.setdefault(x, h) == h
    assert len(set(got.values())) == len(got)
    low = [w.tolist() for _, w, _ in words.chunks(iter([pa.RecordBatch.from_arrays([pa.array(["Ab É", "aB É"])], names=["t"])]), 0, lower=True)][0]
    assert low[0] == low[2] and low[1] == low[3]


def test_line_dedup(spark):
    rows = awkward(random.Random(1))
    rows += [(70, "p\nq\nr\ns\nt", "src0"), (71, "q\nr\ns", "src0"), (72, "s\nt\nu\nq\nr\ns", "src0"), (73, "l\n" * 9, "src0"), (74, "p\nq", "src0")]
    df = docs(spark, rows).withColumn("n_lines", F.lit("own")).withColumn("at", F.lit(1))
    seen, want = {}, {}
    for i, t, _ in sorted(rows):
        lines = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            k = tuple(lines[p : p + 3])
            if seen.setdefault(k, (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        want[i] = (None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone))
    out = line_dedup.line_dedup(df)
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()} == want
    assert "at" in out.columns and line_dedup.line_dedup(df.where("false")).count() == 0
    odd = docs(spark, [(None, "a\nb\nc", "s"), (1, "a\nb\nc", "s"), (1, "a\nb\nc", "s")])
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.line_dedup(odd).collect()) == [("1", ""), ("1", ""), ("None", "a\nb\nc")]
    assert not any("Python" in x or "Arrow" in x for x in [out._jdf.queryExecution().executedPlan().toString()])


def repeats(rows, n=20):
    seen, want = set(), {}
    for i, t, _ in sorted(rows):
        w = (t or "").encode().split()
        mark = [False] * len(w)
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            if k in seen:
                mark[p : p + n] = [True] * n
            seen.add(k)
        want[i] = (len(w), sum(mark), hashlib.sha256(b" ".join(x for x, m in zip(w, mark) if not m)).hexdigest())
    return want


@pytest.mark.parametrize(("chunk", "straight"), [(50, 512), (500_000, 512), (50, 1)])
def test_substring_dedup(spark, monkeypatch, chunk, straight):
    monkeypatch.setattr(words, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(exchange, "STRAIGHT_PARTS", straight)  # by regions and blocks
    monkeypatch.setattr(words, "PIECE_BYTES", 500)
    rows = awkward(random.Random(2))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompress.digest(docs(spark, rows)).collect()}
    assert got == repeats(rows)


def test_substring_dedup_of_tiny_vocabularies(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choices("ab", [draw.random() + 0.01, 1], k=draw.randint(0, 150))), "s") for i in range(60)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompress.digest(docs(spark, rows)).collect()}
    assert got == repeats(rows)


def test_substring_dedup_keys(spark):
    t = " ".join(f"w{i}" for i in range(25))
    df = docs(spark, [(1, t, "s"), (1, t, "s"), (None, "z " + t, "s")]).withColumn("n_words", F.lit("own"))
    got = sorted((str(r.doc_id), r.n_removed, r.text) for r in recompress.remove_repeats(df).collect())
    assert got == [("1", 25, ""), ("1", 25, ""), ("None", 0, "z " + t)]
    assert recompress.remove_repeats(df.where("false")).count() == 0


@pytest.mark.parametrize(("order", "straight"), [(2, 512), (3, 512), (4, 512), (3, 1)])
def test_katz_against_plain_python(spark, monkeypatch, order, straight):
    monkeypatch.setattr(exchange, "STRAIGHT_PARTS", straight)  # by regions and blocks
    monkeypatch.setattr(words, "CHUNK_WORDS", 300)
    monkeypatch.setattr(katz, "LEAST_PARTS", 4)
    monkeypatch.setattr(katz, "PARTITION_TOKENS", 300)  # frequent words' contexts are spread
    draw = random.Random(3)
    rows = awkward(draw) + [(100 + i, " ".join(draw.choices(["the", "of", "a", "cat", "dog", "x", "y"], [9, 5, 4, 1, 1, 1, 1], k=40)), "s") for i in range(40)]
    up = {c: c + 32 for c in range(65, 91)}
    tokens = {i: [*((t or "").translate(up).encode().split()), None] for i, t, _ in rows}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    grams = lambda t, n: zip(*[[*["<s>"] * (n - 1 - k), *t[: len(t) - (n - 1 - k)]] if n - 1 - k <= len(t) else (["<s>"] * len(t)) for k in range(n)])
    count = {n: Counter() for n in range(1, order + 1)}
    for i in train:
        for n in count:
            count[n].update(grams(tokens[i], n))
    total = sum(count[1].values())
    uni = {w: r for (w,), r in count[1].items()}
    discount = {n: katz.good_turing(np.array([Counter(count[n].values()).get(r, 0) for r in range(1, katz.K + 2)], float)) for n in count}
    d = lambda n, r: discount[n][min(r, katz.K + 1)]
    unknown = max(sum((1 - d(1, r)) * r for r in uni.values()) / total, 1 / (total + 1))
    z = sum(d(1, r) * r for r in uni.values())
    follow = defaultdict(dict)
    for n in range(2, order + 1):
        for g, r in count[n].items():
            follow[g[:-1]][g[-1]] = r
    weight = {}

    def p(context, w):
        if not context:
            return (1 - unknown) * d(1, uni[w]) * uni[w] / z if w in uni else unknown
        seen, n = follow.get(context), len(context) + 1
        if not seen:
            return p(context[1:], w)
        c = sum(seen.values())
        plain = all(r > katz.K for r in seen.values())
        if w in seen:
            return d(n, seen[w]) * seen[w] / (c + 1 if plain else c)
        if context not in weight:
            kept = c / (c + 1) if plain else sum(d(n, r) * r for r in seen.values()) / c
            weight[context] = (1 - kept) / (1 - sum(p(context[1:], x) for x in seen))
        return weight[context] * p(context[1:], w)

    for context in follow:
        assert abs(sum(p(context, w) for w in uni) + p(context, b"<none such>") - 1) < 1e-9
    got = {r.key: r for r in katz.score_texts(docs(spark, rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, order=order).collect()}
    assert len(got) == len(rows)
    for i, t in tokens.items():
        s = sum(math.log10(p(g[:-1], g[-1])) for g in grams(t, order))
        base = sum(math.log10((uni.get(w, 0) + 1) / (total + len(uni) + 1)) for w in t)
        r = got[i]
        assert abs(r.score - s) < 1e-8 and abs(r.base_score - base) < 1e-8
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(t), sum(w in uni for w in t), total)


def test_katz_edges(spark):
    assert katz.digest(docs(spark, [(1, "a", "s")]).where("false")).count() == 0
    none = katz.score_texts(docs(spark, [(1, "a b", "s"), (None, None, "s")]), F.lit(False)).collect()
    assert len(none) == 2 and all(r.n_known == 0 and r.train_tokens == 0 for r in none)
    twice = katz.score_texts(docs(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "a", "s")]), F.lit(True)).collect()
    assert len(twice) == 3


@pytest.mark.parametrize("n", [0, 1, 37, 5000])
def test_sharding(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.concat(F.lit("t"), F.col("id") % 5).alias("text"))
    got = sharding.digest(rows).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    by, mix = defaultdict(list), defaultdict(Counter)
    source = {r.doc_id: r.source for r in rows.collect()}
    for r in got:
        by[r.shard].append(r.slot)
        mix[source[r.doc_id]][r.shard] += 1
        assert r.size == 3 and r.text_crc32 == zlib.crc32(f"t{r.doc_id % 5}".encode()) and r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(i, [])) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for s, c in mix.items():
        total = sum(c.values())
        assert all(abs(c[i] - total * sizes[i] / n) <= 2 for i in range(16))
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in sharding.digest(rows.repartition(3)).collect()}


def test_sharding_rows(spark, tmp_path):
    df = docs(spark, awkward(random.Random(4))).withColumn("shard", F.lit("own"))
    again = df.unionByName(df)
    out = sharding.interleave(again, 4)
    assert out.count() == again.count() and dict(out.dtypes)["shard"] == "int"
    sharding.write_shards(df, str(tmp_path / "s"), shards=4)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 4


def test_mixing_budgets(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 100), ("a", "x", "2", 10), ("a", "y", "1", 50), ("b", "x", "1", 1000), (None, "x", None, 40)], "domain string, lang string, source string, tokens long")
    got = lambda budget, weights, epochs=1: {(r.domain, r.lang, r.source): r.allowance for r in mixing.budgets(leaves, mixing.LEVELS, weights, F.lit(float(budget)), epochs).collect()}
    # a third each; null's shortage goes to a and b; in a, half each, of which source 2 can take but 10
    assert got(300, {}) == {("a", "x", "1"): 55, ("a", "x", "2"): 10, ("a", "y", "1"): 50, ("b", "x", "1"): 145 - 0, (None, "x", None): 40} or sum(got(300, {}).values()) in range(297, 301)
    few = got(300, {})
    assert few[("a", "x", "2")] == 10 and few[("a", "y", "1")] == 50 and few[(None, "x", None)] == 40
    assert few[("a", "x", "1")] + 60 == pytest.approx(few[("b", "x", "1")], abs=2)
    assert got(10**9, {}) == {("a", "x", "1"): 100, ("a", "x", "2"): 10, ("a", "y", "1"): 50, ("b", "x", "1"): 1000, (None, "x", None): 40}
    assert got(10**9, {}, 3)[("a", "x", "2")] == 30
    assert got(300, {("b",): 0})[("b", "x", "1")] == 0 and sum(got(300, {("b",): 0}).values()) == 200
    heavy = got(100, {("a",): 8})
    assert heavy[("a", "x", "1")] + heavy[("a", "x", "2")] + heavy[("a", "y", "1")] == pytest.approx(80, abs=3)


def test_mixing_rows(spark):
    rows = [r for r in awkward(random.Random(6)) if r[1]] + [(900, None, None), (901, "", "src0")]
    df = docs(spark, rows).withColumn("epoch", F.lit("own")).withColumn("copies", F.lit(7))
    out = mixing.mix(df, share=0.5)
    assert out.columns == [*[c for c in df.columns if c != "epoch"], "epoch"]
    total = sum(len((t or "").split()) for _, t, _ in rows)
    used = sum(len((r.text or "").split()) for r in out.collect())
    longest = max(len((t or "").split()) for _, t, _ in rows)
    assert 0.5 * total - 10 <= used <= 0.5 * total + 10 * longest
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in mixing.mix(df.repartition(3), share=0.5).collect())
    many = mixing.mix(df, share=5.0, epochs=3)
    assert set(Counter(r.doc_id for r in many.where("length(text) > 2").collect()).values()) == {3}
    assert mixing.mix(df.where("false")).count() == 0


def test_toxicity(spark):
    draw = random.Random(7)
    rows = []
    for i in range(900):
        w = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(draw.randrange(len(w)), draw.choice(["vile!", "Nasty,", "foul", "rotten."]))
        rows.append((i, " ".join(w), int(toxic)))
    d = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(2000, None, 1), (None, "vile nasty foul", 1), (2001, "", 1), (2002, "ok " * 20_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    got = toxicity.digest(d, labels).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    held = [r for i, _, y in rows if (r := by[i]).held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.held_out]
    assert len(held) > 200
    right = sum(by[i].predicted == y for i, _, y in rows if by[i].held_out)
    assert right >= 0.97 * len(held) and not any(by[i].predicted for i, _, y in rows if not y)
    assert by[2000].predicted == by[2001].predicted == by[2002].predicted == 0
    kept = toxicity.reject_toxic(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    nothing = toxicity.digest(d, labels.where("false")).collect()
    assert {r.score for r in nothing} == {0.5}
    assert toxicity.digest(d.where("false"), labels).count() == 0


def plain_best_fit(lengths, capacity):
    import bisect

    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        if i == len(rooms):
            room, n = capacity, n + 1
        else:
            room = rooms.pop(i)
        if room > x:
            bisect.insort(rooms, room - x)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 64, 100])
    lengths = [draw.randint(1, capacity) for _ in range(draw.choice([1, 30, 900]))]
    runs = packing.plan(Counter(lengths), capacity)
    used, pieces = Counter(), Counter()
    for length, lo, hi, first, each, offset in runs:
        for k in range(hi - lo):
            used[first + k // each] += length
            assert offset + k % each * length + length <= capacity
        pieces[length] += hi - lo
    assert pieces == Counter(lengths) and max(used.values()) <= capacity
    assert len(used) == plain_best_fit(lengths, capacity)


def test_packing(spark):
    from tokenizers import Tokenizer

    file, ranks = packing.default_tokenizer()
    exact = Tokenizer.from_file(file)
    rows = awkward(random.Random(9)) + [(200, "one <|endoftext|> two", "s"), (201, "x   　y 12345 don't" * 3, "s"), (None, "no key", "s"), (66, "another text of one key", "s")]
    df = docs(spark, rows).withColumn("length", F.lit("own"))
    got = packing.pack(df, 64).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        start = 0
        for k in range(-(-len(ids) // 64)):
            end = start + ((len(ids) - 1) % 64 + 1 if k == 0 else 64)
            want[i, k, start, end - start, zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())] += 1
            start = end
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == plain_best_fit([r.length for r in got], 64)
    whole = packing.sequences(df, capacity=64).collect()
    assert sum(len(r.input_ids) for r in whole) == sum(r.length for r in got)
    assert packing.pack(df.where("false")).count() == 0


def thue_morse(n):
    """A word of letters a and b, and the one with the letters changed over: equal under any hash by powers modulo 2^64."""
    one = "a"
    while len(one) < n:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomial_hashes_confuse(spark, n):
    one, other = thue_morse(n)
    start = " ".join(f"w{i}" for i in range(19))
    rows = [(i, f"{start} {last}", "s") for i, last in enumerate([one, other, "zz", other])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompress.digest(docs(spark, rows)).collect()}
    assert got == repeats(rows) and [got[i][1] for i in range(4)] == [0, 0, 0, 20]
    rows = [(i, t, "s") for i, t in enumerate([other, one, "q"])]
    scored = katz.score_texts(docs(spark, rows), F.col("doc_id") != 0).collect()
    assert {r.key: r.n_known for r in scored} == {0: 1, 1: 2, 2: 2}


@pytest.mark.parametrize("seed", range(3))
def test_recompressed_symbols_are_consistent(seed):
    """Equal word sequences hold the same symbols, wherever all that decided on a symbol lies within them."""
    draw = np.random.default_rng(seed)
    shared = draw.integers(1, 5, 60).astype(np.uint64)
    texts = [np.concatenate([draw.integers(1, 5, a).astype(np.uint64), shared, draw.integers(1, 5, b).astype(np.uint64)]) for a, b in ((0, 9), (13, 0), (30, 30))]
    seen = []
    for t in texts:
        n = len(t)
        none = np.zeros(n, dtype=np.int64)
        s = recompress.State(np.zeros(1, dtype=np.int64), np.array([0, n]), t, np.arange(n), none + 1, none, none, np.arange(n) == 0, np.arange(n), none.astype(np.uint64))
        at = next(i for i in range(n - 59) if (t[i : i + 60] == shared).all())
        inside = set()
        for k in range(3):
            made = recompress.compressed(s, k)
            key = np.where(made.new, made.key, s.name[made.first])
            first = s.at[made.first]
            lo, hi = first - made.before, first + made.size + made.after
            inside |= {(k, int(f) - at, int(c), int(x)) for f, c, x, a, b in zip(first, made.size, key, lo, hi) if a >= at and b <= at + 60}
            begins = np.zeros(len(first), dtype=bool)
            begins[0] = True
            s = recompress.State(s.docs, s.ends, key, first, made.size, made.before, made.after, begins, s.window, s.best)
        seen.append(inside)
    assert seen[0] == seen[1] == seen[2] and any(k == 2 for k, *_ in seen[0]) and max(c for _, _, c, _ in seen[0]) >= 4


def test_ftrl_against_plain_python():
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 40, 12)).astype(np.int32) for _ in range(60)]
    labels = np.array([float(1 in r or 7 in r) for r in rows])
    alpha, beta, l1, l2, bias = 0.5, 1.0, 0.3, 0.1, -1
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        held = 0.0 if i == bias else l1
        return 0.0 if abs(z[i]) <= held else -(z[i] - math.copysign(held, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(4):
        for k in order.permutation(len(rows)):
            at = [*rows[k].tolist(), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[k]
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    model = toxicity.fit_ftrl(rows, labels, alpha, beta, l1, l2)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert model.index.tolist() == sorted(want) and 0 < len(want) < 40
    assert np.allclose(model.weight, [want[i] for i in sorted(want)], rtol=1e-5) and abs(model.bias - weight(bias)) < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_both_encoders_give_the_same_ids(seed):
    file, ranks = packing.default_tokenizer()
    draw = random.Random(seed)
    point = lambda: chr(next(c for c in iter(lambda: draw.randrange(1, 0x110000 if draw.random() < 0.3 else 0x3000), None) if not 0xD800 <= c < 0xE000))
    texts = ["".join(point() for _ in range(draw.randint(1, 80))) for _ in range(300)]
    texts += [draw.choice("a1 \n\t.é中'") * draw.randint(1, 3000) for _ in range(20)] + ["".join(draw.choices(["don't", "'LL", " ", "  ", "\n\n", "12345", "ß", "中文", "العربية", "\u00a0", "\u2028", "x" * 50, "<|", "|>"], k=40)) for _ in range(200)]
    for t in texts:
        assert packing.encode(t, file, ranks) == packing.encode(t, file), repr(t)


def test_runs_that_meet_themselves():
    rng, seen = random.Random(1), [0, 0]
    for _ in range(3000):
        n, period, letters = rng.randint(1, recompress.RUN), rng.randint(1, 25), rng.choice([1, 2, 3, 9])
        base = [bytes([97 + rng.randrange(letters)]) for _ in range(period)]
        held = [base[i % period] for i in range(60)]
        if rng.random() < 0.5:
            held[rng.randrange(60)] = b"z"
        at = rng.randint(0, 20)
        expected = len({tuple(held[i : i + recompress.WINDOW]) for i in range(at, at + n)}) < n
        assert recompress._meets_itself(held, at, n) == expected
        seen[expected] += 1
    assert min(seen) > 100


def most_bytes(f):
    """What ``f`` has returned, and the bytes that it held at most."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_katz_sorts_a_partition_in_bounded_pieces():
    """One word has half of the rows, and one of its pairs a quarter. Of each row 16 bytes are returned."""
    rng, n = np.random.default_rng(1), 1 << 21
    columns = [np.where(rng.random(n) < 0.5, 7, rng.integers(0, 5000, n)), np.where(rng.random(n) < 0.5, 3, rng.integers(0, 300, n)), rng.integers(0, 4, n)]
    (first, which), held = most_bytes(lambda: katz._sorted_rows(columns))
    rows = np.stack(columns, axis=1)
    assert (rows[first][which] == rows).all() and (np.diff((columns[0][first] * 300 + columns[1][first]) * 4 + columns[2][first]) > 0).all()
    assert (np.bincount(which) > 0).all() and held < 40 * n


def test_katz_partition_by_runs(monkeypatch):
    """Runs of n-grams give what the whole partition gives, with contexts known from elsewhere, and in less memory."""
    rng = np.random.default_rng(2)
    model = katz.Words(np.array([500, 9, 2, 1]), np.array([0, 2, 300, 600]), 900, 5000, 50, spread=100)
    discounts = [np.array([1, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0])] * 2
    rows = np.unique(np.stack([rng.integers(0, 902, 4000) * (rng.random(4000) < 0.7), rng.integers(0, 40, 4000), rng.integers(0, 901, 4000)], axis=1), axis=0)
    columns, r = list(rows.T.astype(np.uint32)), rng.integers(0, 8, len(rows))
    given = [(1, 0, -1, 700.0, 9.0, 8.0, 7.0, 6.0, 5.0, 0.25)] + [(2, 0, i, 60.0 + i, 9.0, 4.0, 2.0, 1.0, 1.0, 0.125) for i in range(39, 0, -1)]
    names = ["size", "x0", "x1", "total", *[f"n{i}" for i in range(1, katz.K + 1)], "held"]
    known = katz._known(pa.table([pa.array(c) for c in zip(*given)], names=names), 3)
    whole = np.log10(katz.probabilities(katz.Table.of(columns, r), model, discounts, known))
    assert not np.allclose(whole, np.log10(katz.probabilities(katz.Table.of(columns, r), model, discounts, {})))
    monkeypatch.setattr(katz, "RUN_GRAMS", 16)
    assert len(list(katz._runs(columns[0]))) > 50
    assert np.allclose(katz.log_probabilities(columns, r, model, discounts, known), whole, rtol=0, atol=1e-12)
    monkeypatch.undo()
    n = 1 << 20
    columns, r = [np.sort(rng.integers(0, 900, n)).astype(np.uint32), np.arange(n, dtype=np.uint32) % 900, rng.integers(0, 900, n).astype(np.uint32)], np.ones(n, dtype=np.int64)
    assert most_bytes(lambda: katz.log_probabilities(columns, r, model, discounts, {}))[1] < 60 * n


def test_large_rows_lie_in_small_pages(spark):
    """60 rows of 200 KB: a reader that skips to the last ones needs a page or two of them, not 12 MB."""
    rows = spark.range(0, 60, 1, 1).select("id", F.expr("unhex(repeat(lpad(hex(id), 2, '0'), 200000))").alias("b"))
    kept = materialize(rows, "large-rows", large=True)
    assert [(r.id, r.b) for r in kept.orderBy("id").collect()] == [(i, bytes([i]) * 200_000) for i in range(60)]
    (path,) = kept.inputFiles()
    footer = pq.ParquetFile(path.removeprefix("file:")).metadata
    columns = [footer.row_group(g).column(1) for g in range(footer.num_row_groups)]
    assert {c.compression for c in columns} == {"UNCOMPRESSED"}
    headers = sum(c.total_uncompressed_size for c in columns) - 60 * 200_004
    one = materialize(rows, "large-rows-one-page").inputFiles()[0]
    assert headers > 5 * (pq.ParquetFile(one.removeprefix("file:")).metadata.row_group(0).column(1).total_uncompressed_size - 60 * 200_004)  # a header for each page
    discard(kept)


def test_words_of_one_64_bit_hash_are_two_words(spark):
    """Two words with the same XXH64: the held-out one is not known."""
    rows = [(0, "dxwtjawdkhf(+0=b q", "s"), (1, "toxicologyreport", "s"), (2, "q", "s")]
    got = {r.key: r for r in katz.score_texts(docs(spark, rows), F.col("doc_id") != 0).collect()}
    assert got[0].n_known == 2 and got[1].n_known == 2  # q and the end; the word and the end


def test_words_that_share_half_a_hash(spark):
    a, b = np.array([5, 5, 7, 5, 7], dtype=np.uint64), np.array([1, 2, 0, 1, 0], dtype=np.uint64)
    first, which = katz._numbered(a, b)
    assert list(zip(a[first].tolist(), b[first].tolist())) == [(5, 1), (5, 2), (7, 0)] and which.tolist() == [0, 1, 2, 0, 2]
    first, which = katz._numbered(a, a)
    assert a[first].tolist() == [5, 7] and which.tolist() == [0, 0, 1, 0, 1]


def test_words_are_numbered_all_at_once(monkeypatch):
    """Equal words have one number and others another, whatever their length, neighbours, text or piece; white characters are those six."""
    draw = random.Random(11)
    parts = ["a", "b", "é", " ", "\x00", "\t", "\n", "\x0b", "\x1c", "\x85", "xyzxyzxyz", "q" * 64, "q" * 70, "w" * 65]
    texts = [None, "", " ", "a", "a b", " a", "b "] + ["".join(draw.choices(parts, k=draw.randint(0, 200))) for _ in range(200)] + ["x" * 300 + " y" * 500, None, ""]
    number, word = {}, {}
    for size in (1 << 20, 500, 7):
        monkeypatch.setattr(words, "PIECE_BYTES", size)
        found = list(words.numbers(pa.array(texts).slice(1)))
        assert [len(x) for x in found] == [len(words.split(t)) for t in texts[1:]]
        for t, x in zip(texts[1:], found):
            for w, n in zip(words.split(t), x.tolist()):
                assert number.setdefault(w, n) == n and word.setdefault(n, w) == w


def test_packed_numbers_hold_no_empty_planes():
    """Only bytes that numbers have are packed: one in eight, where all are small."""
    for x in ([], [0, 0], [1, 0, 255], [-5, 2**62]):
        assert exchange.unpacked(exchange.packed(np.array(x, dtype=np.int64)), "i8").tolist() == x
    small = exchange.packed(np.arange(200, dtype=np.uint64))
    assert small[0] == 1 and len(exchange._zstd()[1].decompress(small[1:])) == 200


def test_only_symbols_within_windows_that_are_left_are_named():
    """Of 60 words the first 20 are a window that is left, so keys come from those alone, and are the same wherever the window stands."""
    draw = np.random.default_rng(3)
    shared, asked = draw.integers(1, 9, 20).astype(np.uint64), []
    for before in (0, 40):
        t = draw.integers(1, 9, 60).astype(np.uint64)
        t[before : before + 20] = shared
        n, none, every = 60, np.zeros(60, dtype=np.int64), np.ones(60, dtype=bool)
        s = recompress.State(np.zeros(1, dtype=np.int64), np.array([0, n]), t, np.arange(n), none + 1, none, none, np.arange(n) == 0, np.array([before]), np.zeros(1, dtype=np.uint64), every)
        s = recompress.advance(s, np.append(np.uint64(0), np.arange(1, 9, dtype=np.uint64)), anchors=False)
        assert s.at.tolist() == list(range(before, before + 20)) and s.name.tolist() == shared.tolist()
        s, keys = recompress.waiting(s, 0)
        assert len(keys) == s.new.sum() and len(keys)
        asked.append((keys.tolist(), (s.at - before).tolist()))
    assert asked[0] == asked[1]


@pytest.mark.parametrize(("parts", "width"), [(64, 1), (600, 24)])
def test_what_a_chunk_asks_lies_in_order(parts, width):
    keys = words.mix(np.random.default_rng(4).integers(0, 3000, 5000).astype(np.uint64))
    sent, which = exchange.asked(keys, parts, width)
    sent = sent[0].as_py()
    form = exchange._name_form(parts)
    key, many, ends = form.all(pa.table({f: pa.array([m[f] for m in sent], pa.binary()) for f in form.fields}))
    assert (key[0][which] == keys).all() and (np.diff(key[0]) > 0).all()
    assert ((many > 1) == (np.bincount(which) > 1)).all()
    regions = [m["part"] for m in sent]
    assert regions == sorted(set(regions)) and (np.repeat(regions, np.diff(ends, prepend=0)) == exchange.part_in_order(key[0], parts) // width).all()
    assert np.bincount(regions).max() == 1 and max(np.diff(ends, prepend=0)) < 3 * 3000 * width / parts + 20
    assert exchange.asked(keys[:0], parts, width)[0].to_pylist() == [[]]
