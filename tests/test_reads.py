import random

import pytest

from braidwork.operators import reads as R, segments
from braidwork.operators.counting import count_all
from braidwork.operators.sets import KmerSet
from braidwork.sources import readers

from . import brute


def frame(spark, seqs, quals=None):
    return spark.createDataFrame([(i, f"r{i}", s, None if quals is None else quals[i]) for i, s in enumerate(seqs)], readers.READS)


@pytest.fixture(scope="module")
def data(spark):
    draw = random.Random(7)
    seqs = ["".join(draw.choices("ACGTN", [8, 8, 8, 8, 1], k=n)) for n in (0, 2, 3, 30, 60, 300, 300)]
    k = 3
    kept = {w: c for w, c in brute.count(seqs, k).items() if c % 3}
    s = KmerSet(spark.createDataFrame(list(kept.items()), "kmer string, cnt long"), k)
    want = {i: [kept.get(brute.canonical(w), 0) if w else 0 for w in brute.windows(q, k)] for i, q in enumerate(seqs)}
    return frame(spark, seqs), s, seqs, want


def test_counters(data):
    r, s, _, want = data
    assert {x.read_id: x.counters for x in R.counters(r, s).collect()} == want


def test_filter(data):
    r, s, seqs, want = data
    valid = {i: sum(c > 0 for c in w) for i, w in want.items()}
    assert {x.read_id for x in R.filter_reads(r, s, 10, 60).collect()} == {i for i, v in valid.items() if 10 <= v <= 60}
    assert {x.read_id for x in R.filter_reads(r, s, 0.3, 0.9).collect()} == {i for i, v in valid.items() if int(0.3 * max(0, len(seqs[i]) - 2)) <= v <= int(0.9 * max(0, len(seqs[i]) - 2))}
    assert {x.read_id: x.n_valid for x in R.valid_windows(r, s).collect()} == valid


def test_trim_and_mask(data):
    r, s, seqs, want = data
    trimmed, masked = {}, {}
    for i, q in enumerate(seqs):
        bad = [j for j, c in enumerate(want[i]) if c < 4]
        if want[i] and (not bad or bad[0] > 0):
            trimmed[i] = q if not bad else q[: 3 + bad[0] - 1]
        masked[i] = "".join("N" if any(j <= x < j + 3 for j in bad) else c for x, c in enumerate(q))
    assert {x.read_id: x.seq for x in R.trim_reads(r, s, 4).collect()} == trimmed
    assert {x.read_id: x.seq for x in R.mask_reads(r, s, 4).collect()} == masked


def test_stated_cases(spark):
    s = KmerSet(spark.createDataFrame([("ACG", 5), ("GTA", 7), ("TAC", 7)], "kmer string, cnt long"), 3, both_strands=False)
    r = frame(spark, ["ACGTAC"], ["abcdef"])
    assert R.counters(r, s).first().counters == [5, 0, 7, 7]
    assert R.mask_reads(r, s, 2).first().seq == "ANNNAC"
    cut = R.trim_reads(r, s, 2).first()
    assert (cut.seq, cut.qual) == ("ACG", "abc")
    with pytest.raises(ValueError):
        R.filtered(r, s, "trim", 0.5)
    assert R.filtered(r, s, "mask", 2).first().seq == "ANNNAC"


def test_segments(spark):
    draw = random.Random(9)
    seqs = ["".join(draw.choices("ACGTN", [10, 10, 10, 10, 1], k=n)) for n in (5, 20, 60, 400)] + ["ACG" * 150, "A" * 600]
    r = frame(spark, seqs)
    got = {}
    for x in segments.super_kmers(r, 15, 5).collect():
        got.setdefault(x.read_id, []).append((x.start, x.len, x.signature))
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, q in enumerate(seqs) if (v := brute.super_kmers(q, 15, 5))}
    by_signature = {x.kmer: x.cnt for x in segments.count_by_signature(r, 15, 5).collect()}
    assert by_signature == {x.kmer: x.cnt for x in count_all(r, 15).collect()}
    stats = {x.signature: x.n_kmers for x in segments.signature_statistics(r, 15, 5).collect()}
    want = {}
    for q in seqs:
        for w in brute.windows(q, 15):
            if w:
                want[brute.signature(w, 5)] = want.get(brute.signature(w, 5), 0) + 1
    assert stats == want
