import random

import pytest

from braidwork.operators.sets import COUNTER_RULES, KmerSet, Output, simple
from braidwork.plans.expression import evaluate, parse, parse_definition, tokens


def made(spark, counts, **meta):
    return KmerSet(spark.createDataFrame(list(counts.items()) or [("A", 1)], "kmer string, cnt long").where("true" if counts else "false"), 3, **meta)


def counted(s):
    return {r.kmer: r.cnt for r in s.df.collect()}


@pytest.fixture(scope="module")
def pair():
    draw = random.Random(3)
    words = ["".join(draw.choices("ACGT", k=3)) for _ in range(60)]
    return ({w: draw.randint(1, 9) for w in words[:35]}, {w: draw.randint(1, 9) for w in words[20:]})


RULES = {"min": min, "max": max, "sum": lambda a, b: a + b, "diff": lambda a, b: a - b, "left": lambda a, b: a, "right": lambda a, b: b}


@pytest.mark.parametrize("rule", COUNTER_RULES)
def test_rules(spark, pair, rule):
    a, b = pair
    x, y, f = made(spark, a), made(spark, b), RULES[rule]
    keep = lambda d: {w: c for w, c in d.items() if c > 0}
    assert counted(x.intersect(y, rule)) == keep({w: f(a[w], b[w]) for w in a if w in b})
    assert counted(x.union(y, rule)) == keep({w: f(a[w], b[w]) if w in a and w in b else a.get(w, b.get(w)) for w in a | b})
    assert counted(x.counters_subtract(y, rule)) == keep({w: f(a[w], b[w]) if w in b else a[w] for w in a})
    assert counted(x.reverse_counters_subtract(y, rule)) == keep({w: f(b[w], a[w]) if w in a else b[w] for w in b})


def test_subtract_and_laws(spark, pair):
    a, b = pair
    x, y = made(spark, a), made(spark, b)
    assert counted(x.kmers_subtract(y)) == {w: c for w, c in a.items() if w not in b}
    assert counted(x.reverse_kmers_subtract(y)) == {w: c for w, c in b.items() if w not in a}
    assert x.size() + y.size() == x.intersect(y).size() + x.union(y).size()
    assert x.kmers_subtract(y).intersect(y).size() == 0
    assert x.same_as(x) and not x.same_as(y) and not x.same_as(made(spark, {**a, next(iter(a)): 99}))


def test_empty(spark, pair):
    x, none = made(spark, pair[0]), made(spark, {})
    assert counted(x.union(none)) == pair[0] and x.intersect(none).size() == 0 and counted(x.kmers_subtract(none)) == pair[0]


def test_simple_equals_single_operations(spark, pair):
    x, y = (made(spark, p) for p in pair)
    outputs = {"i": Output("intersect", "max", ci=2), "u": Output("union", cs=4), "k": Output("kmers_subtract"), "c": Output("counters_subtract"), "rk": Output("reverse_kmers_subtract"), "rc": Output("reverse_counters_subtract"), "rl": Output("reverse_counters_subtract", "left")}
    got = {}
    for r in simple(x, y, outputs).collect():
        got.setdefault(r.output, {})[r.kmer] = r.cnt
    assert got["i"] == counted(x.intersect(y, "max", ci=2)) and got["u"] == counted(x.union(y, cs=4))
    assert got["k"] == counted(x.kmers_subtract(y)) and got["c"] == counted(x.counters_subtract(y))
    assert got["rk"] == counted(x.reverse_kmers_subtract(y)) and got["rc"] == counted(x.reverse_counters_subtract(y))
    assert got["rl"] == counted(x.reverse_counters_subtract(y, "left"))
    with pytest.raises(ValueError):
        simple(x, y, {"k": Output("kmers_subtract", "min")})


def test_one_set(spark):
    x = made(spark, {"AAA": 1, "AAC": 3, "ACC": 3, "CCC": 300}, counter_size=2)
    assert counted(x.reduce(2, 1000, 255)) == {"AAC": 3, "ACC": 3, "CCC": 255}
    assert counted(x.compact(2)) == {"AAC": 1, "ACC": 1, "CCC": 1}
    assert {r.cnt: r.n_kmers for r in x.histogram().collect()} == {1: 1, 3: 2, 300: 1}
    dense = {r.cnt: r.n_kmers for r in x.histogram(1, 5, dense=True).collect()}
    assert dense == {1: 1, 2: 0, 3: 2, 4: 0, 5: 0}
    assert [r.kmer for r in x.sort().df.collect()] == ["AAA", "AAC", "ACC", "CCC"]
    assert {r.kmer: r.cnt for r in x.lookup(["aac", "GGG", "TTT"]).collect()} == {"AAC": 3, "GGG": 0, "TTT": 0}
    assert {r.kmer: r.cnt for r in x.lookup(["GTT"], canonical_form=True).collect()} == {"GTT": 3}
    assert {r.cnt for r in x.with_cutoffs(1, 3).lookup(["AAC"], strict_upper=True).collect()} == {0}
    for bad in ("AA", "AAN"):
        with pytest.raises(ValueError):
            x.lookup([bad])
    with pytest.raises(ValueError):
        x.with_cutoffs(2, 9).with_cutoffs(1, 9)
    assert x.contains("aaa") and not x.with_cutoffs(2, 9).contains("AAA")
    assert x.info().first().total_kmers == 4
    with pytest.raises(ValueError):
        x.union(KmerSet(x.df, 4))


def test_write_and_read(spark, tmp_path, pair):
    x = made(spark, pair[0], counter_size=1)
    x.write(str(tmp_path / "s"))
    again = KmerSet.read(spark, str(tmp_path / "s"))
    assert x.same_as(again) and again.k == 3 and again.counter_size == 1
    assert counted(KmerSet.read(spark, str(tmp_path / "s"), 2, 5)) == {w: c for w, c in pair[0].items() if 2 <= c <= 5}


def test_expression(spark, pair):
    a, b = pair
    sets = {"s1": made(spark, a), "s2": made(spark, b), "s3": made(spark, {"AAA": 5, "CCC": 2})}
    got = counted(evaluate("(s3 + min s1) * right s2", sets))
    want = sets["s3"].union(sets["s1"], "min").intersect(sets["s2"], "right")
    assert got == counted(want)
    assert counted(evaluate("s1 - s2 + s3", sets)) == counted(sets["s1"].kmers_subtract(sets["s2"]).union(sets["s3"]))
    assert counted(evaluate("s1 + s2 * s3", sets)) == counted(sets["s1"].union(sets["s2"].intersect(sets["s3"])))
    assert counted(evaluate("s1 ~ s2", sets)) == counted(sets["s1"].counters_subtract(sets["s2"]))
    assert tokens("minute*sum_1") == ["minute", "*", "sum_1"]
    for bad in ("s1 -min s2", "s1 +", "(s1", "s1 $ s2", "s1 s2", "min", "s1 + nine"):
        with pytest.raises(ValueError):
            evaluate(bad, sets)
    assert parse("minute + a").names() == {"minute", "a"}


def test_definition(spark, pair):
    text = "INPUT:\nx = one -ci2 -cx7\ny = two\nOUTPUT:\nout = x * max y\nOUTPUT_PARAMS:\n-ci3 -cs5\n"
    d = parse_definition(text)
    assert d.inputs == {"x": ("one", {"ci": 2, "cx": 7}), "y": ("two", {})} and d.output == "out" and d.limits == {"ci": 3, "cs": 5}
    a, b = pair
    sets = {"one": made(spark, a), "two": made(spark, b)}
    got = counted(d.run(lambda path, ci=None, cx=None: sets[path] if ci is None else sets[path].with_cutoffs(ci, cx)))
    assert got == {w: min(max(c, b[w]), 5) for w, c in a.items() if 2 <= c <= 7 and w in b and max(c, b[w]) >= 3}
    for bad in ("", "INPUT:\nx = a\n", "INPUT:\nx = a\nOUTPUT:\no = y\n", "x = 1"):
        with pytest.raises(ValueError):
            parse_definition(bad)
