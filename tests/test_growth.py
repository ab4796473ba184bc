"""What a task holds does not grow with the table."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from braidwork.functions import windows as W
from braidwork.operators import bins, counting, reads as R, segments
from braidwork.operators.sets import KmerSet
from braidwork.sources import readers

from . import brute


def frame(spark, seqs):
    return spark.createDataFrame([(i, f"r{i}", s, None) for i, s in enumerate(seqs)], readers.READS)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_come_in_parts_of_some_bytes():
    """A batch of 3 MB of text is not worked on at once; every row is in one part, in order."""
    texts = ["ACGT" * 250, None, "é" * 500, ""] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], names=["read_id", "seq"]).slice(3)
    found = list(W.parts(batch, 1, 100_000))
    assert max(sum(len((t or "").encode()) for t in p.column(1).to_pylist()) for p in found) <= 100_000 and len(found) >= 20
    assert [x for p in found for x in p.column(1).to_pylist()] == texts[3:]
    assert [len(p.column(0)) for p in W.parts(pa.RecordBatch.from_arrays([pa.array(["A" * 50] * 3)], names=["seq"]), 0, 10)] == [1, 1, 1]


def test_tasks_see_no_more_than_a_part(spark, monkeypatch):
    """A bin's batch is of one part's windows: with parts of a read each, as many batches as reads."""
    told = bins.survey(frame(spark, ["ACGTTGCA" * 40]), 15)
    monkeypatch.setattr(W, "PART", 1)
    monkeypatch.setattr(W.parts, "__defaults__", (0, 100))
    reads = frame(spark, ["ACGTTGCA" * 40] * 8).coalesce(1)
    rows = bins.dealt(reads, 15, told).collect()
    assert max(len(r.sizes) // 4 + len(r.times) // 8 for r in rows) <= 306
    assert bins.BIN_WINDOWS <= 1_000_000 and R.BUCKET <= 1_500_000


def test_slices_are_those_of_the_text(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choices("ACGTé€𝄞", [9, 9, 9, 9, 1, 1, 1], k=n)) for n in (1, 99, 100, 101, 250)] + [None, "", "A" * 30_000]
    got = {r.read_id: r.seq for r in readers.slices(frame(spark, texts), 100).collect()}
    assert got == {(i << 31) + n: t[at : at + 100] for i, t in enumerate(texts) for n, at in enumerate(range(0, len(t or ""), 100))}


def test_numbers_by_places():
    for x in ([0], [1, 255, 256], [2**62, 0, 5], []):
        x = np.array(x, dtype=np.uint64)
        back, end = R._got(b"?" + R._put(x), 1, len(x))
        assert back.tolist() == x.tolist() and end == 1 + len(R._put(x))


@pytest.mark.parametrize("k", [5, 15, 31, 40, 70])
def test_short_reads_take_no_join(spark, monkeypatch, k):
    """Reads of one piece keep their columns on the way: nothing is joined to them again. Also in several buckets, and without columns of pieces."""
    monkeypatch.setattr(R, "BUCKET", 500)
    monkeypatch.setattr(R, "HOME", 300)
    draw = random.Random(k)
    seqs = [*("".join(draw.choices("ACGTN", [20, 20, 20, 20, 1], k=n)) for n in (0, 3, 90, 400, 900)), None]
    seqs += [seqs[3], seqs[4][:200]]
    kept = {w: c for w, c in brute.count([s for s in seqs if s], k).items() if c % 3}
    r, s = frame(spark, seqs), KmerSet(spark.createDataFrame(list(kept.items()), "kmer string, cnt long"), k)
    want = {i: [kept.get(brute.canonical(w), 0) if w else 0 for w in brute.windows(q or "", k)] for i, q in enumerate(seqs)}
    assert {x.read_id: x.counters for x in R.counters(r, s).collect()} == want
    made = R.filter_reads(r, s, 1, 10**6)
    assert "Join" not in plan(made) and made.columns == r.columns
    assert Counter(made.collect()) == Counter(x for x in r.collect() if sum(c > 0 for c in want[x.read_id]) >= 1)
    for made in (R.trim_reads(r, s, 2), R.mask_reads(r, s, 2)):
        assert "Join" not in plan(made) and made.columns == r.columns and {x.header for x in made.collect()} <= {f"r{i}" for i in range(len(seqs))}
    monkeypatch.setattr(R, "PIECE", 128)
    assert {x.read_id: x.counters for x in R.counters(r, s).collect()} == want
    long = {x.read_id: x.seq for x in R.mask_reads(r, s, 2).collect()}
    monkeypatch.setattr(R, "PIECE", 1 << 16)
    assert long == {x.read_id: x.seq for x in R.mask_reads(r, s, 2).collect()}


def test_runs_stay_runs_where_bins_are_many(spark, monkeypatch):
    """The more bins, the more signatures are too heavy for one; their windows go on in runs, by wider signatures, and only repeats are opened."""
    draw = random.Random(8)
    words = ["".join(draw.choices("ACGT", [4, 3, 2, 1], k=draw.randint(3, 9))) for _ in range(3000)]
    seqs = ["".join(draw.choices(words, k=160))[:800] for _ in range(100)] + ["AC" * 400] * 20
    draw.shuffle(seqs)
    monkeypatch.setattr(bins, "BIN_WINDOWS", 500)
    reads = frame(spark, seqs).coalesce(2)
    told = bins.survey(reads, 21)
    windows = sum(max(0, len(s) - 20) for s in seqs)
    assert told.n >= 100 and (told.of < 0).sum() >= 20 and len(told.opened)
    rows = bins.dealt(reads, 21, told).collect()
    assert sum(len(r.kmers) // 8 for r in rows) < windows / 50
    assert sum(len(r.runs) + len(r.sizes) for r in rows) < 4 * windows
    assert sum(r.reads for r in rows) == 120
    assert {x.kmer: x.cnt for x in counting.count_all(reads, 21).collect()} == brute.count(seqs, 21)


def test_rows_of_several_parts_leave_together(spark, monkeypatch):
    """A task sends each bin a row for all its parts up to HELD_WINDOWS, not one for each part."""
    draw = random.Random(9)
    seqs = ["".join(draw.choices("ACGT", k=400)) for _ in range(40)]
    monkeypatch.setattr(W.parts, "__defaults__", (0, 1000))
    reads = frame(spark, seqs).coalesce(1)
    told = bins.survey(reads, 15)
    assert len(bins.dealt(reads, 15, told).collect()) <= told.n


def test_statistics_of_a_run_read_once(spark):
    """The one row equals that of counts, reads and super-k-mers made one by one; texts are made reads once."""
    draw = random.Random(10)
    seqs = ["".join(draw.choices("ACGTN", [9, 9, 9, 9, 1], k=n)) for n in (0, 1, 20, 21, 300, 700)] + ["A" * 900, "A" * 900, None, "acgt" * 30]
    reads = frame(spark, seqs)
    apart = counting.statistics(counting.count_all(reads, 21), reads, 2, 50, segments.super_kmers(reads, 21, 7))
    assert segments.run_statistics(reads, 21, 7, 2, 50).first().asDict() == apart.first().asDict()
    assert set(segments.run_statistics(reads.where("false"), 21, 7).first()) == {0}
    made = entry.queries()["statistics_super_kmers"](spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
