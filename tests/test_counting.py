import random

import pytest
from pyspark.sql import functions as F

from braidwork.functions import kmers as K
from braidwork.operators import counting
from braidwork.operators.sets import KmerSet
from braidwork.sources import readers

from . import brute


def reads(spark, seqs, quals=None):
    rows = [(i, None, s, None if quals is None else quals[i]) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, readers.READS)


def counted(df):
    return {r.kmer: r.cnt for r in df.collect()}


@pytest.mark.parametrize(
    "seqs,k,expected",
    [
        (["AAA", "AAA", "TTT", "TTT", "TTT"], 3, {"AAA": 5}),
        (["ACGT"], 4, {"ACGT": 1}),
        (["ACGNACG"], 3, {"ACG": 2}),
        (["acg"], 3, {"ACG": 1}),
        (["AC", "", None], 3, {}),
        (["ACTGTACGTATAAGA"], 15, {"ACTGTACGTATAAGA": 1}),
        (["ACTGTACGTATAAGA"], 16, {}),
        (["ACG\n"], 4, {}),
        (["Aß" + "CGT"], 3, {"ACG": 1}),
    ],
)
def test_edges(spark, seqs, k, expected):
    assert counted(counting.count_all(reads(spark, seqs), k)) == expected


@pytest.mark.parametrize("order,expected", [("ACGT", "GTA"), ("ACTG", "TAC"), ("CATG", "TAC")])
def test_orders(spark, order, expected):
    assert counted(counting.count_all(reads(spark, ["GTA"]), 3, order=order)) == {expected: 1}


@pytest.mark.parametrize("k", [1, 4, 21, 60])
@pytest.mark.parametrize("both", [True, False])
def test_random_reads(spark, k, both):
    draw = random.Random(k)
    seqs = ["".join(draw.choices("ACGTacgtN", [9, 9, 9, 9, 1, 1, 1, 1, 1], k=draw.choice([k - 1, k, 40, 700]))) for _ in range(60)]
    assert counted(counting.count_all(reads(spark, seqs), k, both)) == brute.count(seqs, k, both)


def test_long_read(spark):
    seq = "".join(random.Random(1).choices("ACGT", k=20_000))
    assert counted(counting.count_all(reads(spark, [seq]), 31)) == brute.count([seq], 31)


def test_thresholds_see_the_true_count(spark):
    df = spark.createDataFrame([("A", 1), ("C", 3), ("G", 300)], "kmer string, cnt long")
    assert counted(counting.thresholds(df, 2, 1000, 255)) == {"C": 3, "G": 255}
    assert counted(counting.thresholds(df, 2, 255, 255)) == {"C": 3}


def test_defaults(spark):
    made = KmerSet.count(reads(spark, ["A" * 400, "C" * 25]), 25)
    assert counted(made.df) == {"A" * 25: 255}


def test_weighted(spark):
    seqs, quals = ["ACGTACGTTA", "ACGNN", "TTTTT"], ["IIIIIIIII!", "IIIII", '"#$%&']
    got = counted(counting.count_weighted(reads(spark, seqs, quals), 4))
    p = lambda q: max(0.25, 1 - 10 ** (-(ord(q) - 33) / 10))
    want = {}
    for s, q in zip(seqs, quals):
        for i, w in enumerate(brute.windows(s, 4)):
            if w:
                x = 1.0
                for c in q[i : i + 4]:
                    x *= p(c)
                want[brute.canonical(w)] = want.get(brute.canonical(w), 0) + x
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_statistics(spark):
    r = reads(spark, ["AAAA", "AAAC", "GGGG"])
    row = counting.statistics(counting.count_all(r, 3), r, 2, 2).first()
    counts = brute.count(["AAAA", "AAAC", "GGGG"], 3)
    assert (row.n_unique, row.n_total, row.n_reads) == (len(counts), sum(counts.values()), 3)
    assert row.n_below_min == sum(v < 2 for v in counts.values()) and row.n_above_max == sum(v > 2 for v in counts.values())
    empty = reads(spark, []).where("false")
    assert counting.statistics(counting.count_all(empty, 3), empty).first().n_total == 0


def test_functions(spark):
    row = spark.createDataFrame([("GATTACA",)], "x string").select(K.reverse_complement("x").alias("r"), K.packed("x").alias("n"), K.symbol("x", 2).alias("s"), K.symbol_code("x", 2).alias("c"), K.is_kmer("x").alias("k"), K.is_kmer(F.lit("AC\n")).alias("bad")).first()
    assert (row.r, row.n, row.s, row.c, row.k, row.bad) == ("TGTAATC", int("2033010", 4), "T", 3, True, False)
    K.register(spark)
    assert spark.sql("SELECT revcomp('AAC') a, canonical_kmer('TTG') b, packed_kmer('CA') c").first() == ("GTT", "CAA", 4)


def test_k_is_checked(spark):
    with pytest.raises(ValueError):
        counting.count_all(reads(spark, ["A"]), 0)


def test_packed_words(spark):
    rows = [("ACGT" * 20,), ("T" * 80,), ("A" * 80,)]
    df = spark.createDataFrame(rows, "kmer string")
    for k in (1, 30, 31, 32, 62, 63, 80):
        cut = df.selectExpr(f"substr(kmer, 1, {k}) AS kmer")
        got = cut.select("kmer", K.packed_words("kmer", k).alias("w")).select("kmer", "w", K.unpacked("w", k).alias("back")).collect()
        assert all(r.kmer == r.back and len(r.w) == -(-k // 31) for r in got)
