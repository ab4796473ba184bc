import bz2
import gzip
import random

import pytest

from braidwork.operators.counting import count_all
from braidwork.operators.sets import KmerSet
from braidwork.sources import readers, writers
from braidwork.streaming.counting import count_stream, streamed_lines, write_counts

from . import brute

FASTA = ">one first\nACGTAC\nGTA\n>two\r\nNNAC\r\n\n>three\n\n"
FASTQ = "@one\nACGT\n+\n@III\n@two more\nAC\nGT\n+two\nI@\n+I\n@three\n\n+\n\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nTTTT\n")
    with gzip.open(tmp_path / "b.fa.gz", "at") as f:
        f.write(">y\nGG\n")
    with bz2.open(tmp_path / "c.fa.bz2", "wt") as f:
        f.write(">x\nCC\nCC\n")
    (tmp_path / "list").write_text("\n".join(str(tmp_path / n) for n in ("a.fa", "b.fa.gz", "c.fa.bz2")))
    got = sorted((r.header, r.seq) for r in readers.fasta(spark, f"@{tmp_path}/list").collect())
    assert got == [("one first", "ACGTACGTA"), ("three", ""), ("two", "NNAC"), ("x", "CCCC"), ("y", "GG"), ("z", "TTTT")]
    single = {r.header: r.seq for r in readers.fasta(spark, str(tmp_path / "a.fa"), multiline=False).collect()}
    assert single == {"one first": "ACGTAC", "two": "NNAC", "three": ""}
    assert sorted(r.seq for r in readers.line_reads(spark, str(tmp_path / "a.fa")).collect()) == ["ACGTAC", "GTA", "NNAC"]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text(FASTQ)
    got = [(r.header, r.seq, r.qual) for r in readers.fastq(spark, str(tmp_path / "a.fq")).collect()]
    assert got == [("one", "ACGT", "@III"), ("two more", "ACGT", "I@+I"), ("three", "", "")]


@pytest.mark.parametrize(("size", "count", "newline"), [(7, 9, "\n"), (60, 40, "\r\n"), (333, 60, "\n"), (1 << 20, 60, "\r\n")])
def test_split_fastq(spark, tmp_path, size, count, newline):
    rng = random.Random(size)
    reads = []
    for i in range(count):
        n = rng.choice([0, 1, 5, 30, 200])
        reads.append((f"r{i} @+", "".join(rng.choices("ACGTN", k=n)), "".join(rng.choices("@+IIx", k=n))))
    for name, part in (("a", reads[: count // 2]), ("b", reads[count // 2 :]), ("c", [])):
        text = "".join(newline.join(("@" + h, s, "+" + rng.choice(["", h]), q)) + newline for h, s, q in part)
        (tmp_path / f"{name}.fq").write_bytes(text.encode())
    paths = [str(tmp_path / f"{name}.fq") for name in "abc"]
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = readers.fastq(spark, paths, multiline=False)
        assert sorted((r.header, r.seq, r.qual) for r in got.collect()) == sorted(reads)
        assert got.select("read_id").distinct().count() == len(reads)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_split_fastq_of_other_lines(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@one\nAC\nGT\n+\nII\nII\n")
    with pytest.raises(Exception, match="four lines"):
        readers.fastq(spark, str(tmp_path / "a.fq"), multiline=False).collect()


def test_round_trips(spark, tmp_path):
    (tmp_path / "a.fq").write_text(FASTQ)
    reads = readers.fastq(spark, str(tmp_path / "a.fq"))
    writers.write_reads(reads, str(tmp_path / "out.fq"))
    again = readers.fastq(spark, str(tmp_path / "out.fq"))
    assert sorted((r.header, r.seq, r.qual) for r in again.collect()) == sorted((r.header, r.seq, r.qual) for r in reads.collect())
    writers.write_reads(reads, str(tmp_path / "out.fa"), "fasta")
    assert sorted(r.seq for r in readers.fasta(spark, str(tmp_path / "out.fa")).collect()) == sorted(r.seq for r in reads.collect())
    with pytest.raises(Exception, match="without qualities"):
        writers.read_lines(readers.fasta(spark, str(tmp_path / "out.fa"))).collect()


def test_dumps(spark, tmp_path):
    df = spark.createDataFrame([("CC", 2), ("AA", 7)], "kmer string, cnt long")
    lines = lambda d: [r.value for r in d.collect()]
    assert lines(writers.dump_lines(df, in_order=True)) == ["AA\t7", "CC\t2"]
    assert lines(writers.dump_lines(df, 3, separator=" ")) == ["AA 7"]
    assert lines(writers.dump_lines(df, 7, weighted=True)) == ["AA\t7.000000"]
    assert sorted(lines(writers.fasta_count_lines(df))) == [">2\nCC", ">7\nAA"]
    assert lines(writers.histogram_lines(KmerSet(df, 2).histogram())) == ["2\t1", "7\t1"]
    writers.dump(df, str(tmp_path / "d"), in_order=True)
    writers.write_histogram(KmerSet(df, 2).histogram(), str(tmp_path / "h"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "d")).collect()) == ["AA\t7", "CC\t2"]


def test_generated(spark):
    one = readers.generated(spark, 50, 200, 0.5, None, 0.5, seed=1)
    seqs = [r.seq for r in one.collect()]
    assert len(seqs) == 200 and {len(s) for s in seqs} == {50} and set("".join(seqs)) == {"A", "G"}
    assert seqs == [r.seq for r in readers.generated(spark, 50, 200, 0.5, None, 0.5, seed=1).collect()]
    assert seqs != [r.seq for r in readers.generated(spark, 50, 200, 0.5, None, 0.5, seed=2).collect()]
    plain = "".join(r.seq for r in readers.generated(spark, 100, 100).collect())
    assert all(0.2 < plain.count(c) / len(plain) < 0.3 for c in "ACGT")
    with pytest.raises(ValueError):
        readers.generated(spark, 1, 1, 0.9, 0.9)


def test_measurements(spark, tmp_path):
    names = ["User time (seconds)", "System time (seconds)", "Percent of CPU this job got", "Elapsed (wall clock) time (h:mm:ss or m:ss)", "a", "b", "c", "d", "Maximum resident set size (kbytes)", "e"]
    values = ["0.25", "0.01", "98%", "0:01.50", "0", "0", "0", "0", "1556", "7"]
    (tmp_path / "log").write_text('\tCommand being timed: "x"\n' + "".join(f"\t{n}: {v}\n" for n, v in zip(names, values)))
    row = readers.resource_log(spark, str(tmp_path / "log")).first()
    assert (row.user_s, row.cpu_pct, row.wall, row.max_rss_kb) == (0.25, 98.0, "0:01.50", 1556)
    (tmp_path / "r.csv").write_text("a;40;0,5\nb;80;1,25\n;;x\n")
    got = [tuple(r) for r in readers.decimal_comma_csv(spark, str(tmp_path / "r.csv"), "tool string, n int, user_s double").collect()]
    assert got == [("a", 40, 0.5), ("b", 80, 1.25), (None, None, None)]
    runs = spark.createDataFrame([("a", 1, 1, 1, 1, 0.5), ("a", 1, 1, 1, 2, 1.5)], "tool string, n int, t int, k int, rep int, user_s double")
    assert readers.averages(runs).first().avg_user_s == 1.0
    assert tuple(readers.side_by_side(runs).first())[3:5] == (0.5, 1.5)
    writers.append_csv(runs.select("tool", "n", "user_s"), str(tmp_path / "o"))
    writers.append_csv(runs.select("tool", "n", "user_s"), str(tmp_path / "o"))
    assert readers.decimal_comma_csv(spark, str(tmp_path / "o"), "tool string, n int, user_s double").groupBy().sum("user_s").first()[0] == 4.0


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.fa").write_text(">a\nACGTACGT\n")
    run = lambda: write_counts(count_stream(streamed_lines(spark, str(source)), 3), str(tmp_path / "out"), str(tmp_path / "state"), ci=1).awaitTermination()
    run()
    (source / "2.fa").write_text(">b\nACGNACG\n")
    run()
    got = {r.kmer: r.cnt for r in spark.read.parquet(str(tmp_path / "out/batch=1")).collect()}
    assert got == brute.count(["ACGTACGT", "ACGNACG"], 3)
    assert got == {r.kmer: r.cnt for r in count_all(readers.line_reads(spark, str(source)), 3).collect()}
