"""Reads from FASTA and FASTQ files, lists of files, and generators; measurements from logs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import suppress
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows as W

READS = "read_id long, header string, seq string, qual string"
#: Letters of a text stand for symbols in turn; blanks and line ends are left out.
LETTERS, SYMBOLS = "abcdefghijklmnopqrstuvwxyz \n", "ACGTACGTACGTACGTACGTACGTAC"


def file_list(spark: SparkSession, paths: str | Iterable[str]) -> list[str]:
    """Paths as they are given: several, several with commas between, or a file with one a line: after ``@``, or one whose first line is no record but the path of a file.

    Paths in a list may be given from the list's own folder.
    """
    if not isinstance(paths, str):
        return list(paths)
    named = [p for p in paths.removeprefix("@").split(",") if p]
    if paths.startswith("@") or len(named) == 1 and (first := _first_lines(spark, named[0], 1)) and first[0][:1] not in (">", "@") and _beside(spark, named[0], first[0]):
        return [_beside(spark, named[0], line.strip()) or line.strip() for line in (r.value for r in spark.read.text(named[0]).collect()) if line.strip()]
    return named


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """Of one file; none of a folder, a pattern or what is not there."""
    fs, at = _file(spark, path)
    if not fs.exists(at) or not fs.isFile(at):
        return []
    return [r.value for r in spark.read.text(path).limit(n).collect()]


def _beside(spark: SparkSession, listed: str, name: str) -> str | None:
    """A path that a list names, as it is or from the list's folder; none if neither is there."""
    name = name.strip()
    if not name or any(c in name for c in "*?{}[]"):
        return None
    for path in (name, f"{listed.rpartition('/')[0]}/{name}"):
        with suppress(Exception):  # a line of some other text may be no path at all
            fs, at = _file(spark, path)
            if fs.exists(at):
                return path
    return None


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("read_id", F.monotonically_increasing_id())


def fasta(spark: SparkSession, paths: str | Iterable[str], multiline: bool = True) -> DataFrame:
    """Reads of FASTA files, gzip and bzip2 too. Records end where a line begins with ``>``; several files are read side by side.

    ``multiline``: a sequence may have many lines. Else it has one, and what follows in the record is no part of it.
    """
    records = spark.read.option("lineSep", "\n>").text(file_list(spark, paths)).select(F.regexp_replace("value", "^>", "").alias("record"))
    parts = records.where(F.trim("record") != "").select(F.split("record", "\r?\n", 2).alias("p"))
    body = F.coalesce(F.get("p", F.lit(1)), F.lit(""))
    seq = F.regexp_replace(body, "\\s", "") if multiline else F.element_at(F.split(body, "\r?\n"), 1)
    return _numbered(parts.select(F.get("p", F.lit(0)).alias("header"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"))).select("read_id", "header", "seq", "qual")


def line_reads(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Each line that is no header is a read."""
    rows = spark.read.text(file_list(spark, paths)).where("value <> '' AND NOT startswith(value, '>')")
    return _numbered(rows.select(F.lit(None).cast("string").alias("header"), F.rtrim("value").alias("seq"), F.lit(None).cast("string").alias("qual"))).select("read_id", "header", "seq", "qual")


_RECORD = "header string, seq string, qual string"
_FRAGMENT = "path string, start long, synced boolean, before array<string>, after array<string>"


def _record_batch(made: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made)], names=["header", "seq", "qual"])


def _in_batches(found: Iterable[tuple[str, str, str]], size: int = 4096) -> Iterator[pa.RecordBatch]:
    rest = iter(found)
    while made := list(islice(rest, size)):
        yield _record_batch(made)


#: Lines of a FASTQ file that are looked at to tell how its records lie.
_LOOKED_AT = 4000


def _by_fours(spark: SparkSession, paths: list[str]) -> bool:
    """Whether the first file's first records have four lines each. Files that only a pattern names are taken to."""
    lines = [line.rstrip("\r") for line in _first_lines(spark, paths[0], _LOOKED_AT) if line.strip("\r")] if paths else []
    fours = [lines[i : i + 4] for i in range(0, len(lines) - 3, 4)]
    whole = len(lines) >= _LOOKED_AT - 3 or len(lines) % 4 == 0
    return whole and all(f[0].startswith("@") and f[2].startswith("+") and len(f[1].strip()) == len(f[3]) for f in fours)


def fastq(spark: SparkSession, paths: str | Iterable[str], multiline: bool | None = None) -> DataFrame:
    """Reads of FASTQ files.

    ``multiline``: sequences and qualities may have several lines. A quality line may begin like a header,
    so only from a file's start is it sure what a line is: a file is one task and is held there whole,
    2 GB at most. Else (False) each record has four lines, which can be told apart from anywhere in a file, and
    files of any size split into many tasks; records that lie across splits are put together by file.
    Lines that do not come in fours are an error then, but for blank ones between records. Not said: as
    the first file's first records are.
    """
    if multiline is None:
        paths = file_list(spark, paths)
        multiline = not _by_fours(spark, paths)
    if not multiline:
        return _split_fastq(spark, file_list(spark, paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(records(line for b in batches for text in b.column(0).to_pylist() for line in text.split("\n")))

    whole = spark.read.text(file_list(spark, paths), wholetext=True)
    found = whole.select("value").mapInArrow(run, _RECORD)
    return _numbered(found).select("read_id", "header", "seq", "qual")


class _Split:
    """The lines of one split of a file, which come in order: whole records, and what its ends hold of others."""

    def __init__(self, path: str, start: int):
        self.path, self.start, self.synced = path, start, start == 0
        self.before: list[str] = []
        self.held: list[str] = []

    def add(self, lines: list[str]) -> Iterator[tuple[str, str, str]]:
        self.held += lines
        if not self.synced:
            # A quality line may begin with @ too, but two lines after it there is a sequence, not a line with +.
            at = next((i for i in range(len(self.held) - 2) if self.held[i].startswith("@") and self.held[i + 2].startswith("+")), None)
            if at is None:
                keep = max(0, len(self.held) - 2)
                self.before += self.held[:keep]
                self.held = self.held[keep:]
                return
            self.before += self.held[:at]
            self.held, self.synced = self.held[at:], True
        at = 0
        while at < len(self.held):
            if not self.held[at]:
                at += 1
                continue
            if at + 4 > len(self.held):
                break
            header, seq, plus, qual = self.held[at : at + 4]
            if not header.startswith("@") or not plus.startswith("+"):
                raise ValueError(f"{self.path}: records are not of four lines each near {header!r}; read it with multiline=True")
            yield header[1:], seq.strip(), qual
            at += 4
        self.held = self.held[at:]

    def ends(self) -> tuple[str, int, bool, list[str], list[str]]:
        return (self.path, self.start, True, self.before, self.held) if self.synced else (self.path, self.start, False, self.before + self.held, [])


def _of_splits(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple]:
    """Whole records of all splits of a task, or else the ends of its splits."""
    now = None
    for b in batches:
        paths, starts, lines = (b.column(i).to_pylist() for i in range(3))
        for (path, start), group in groupby(range(b.num_rows), key=lambda i: (paths[i], starts[i])):
            if now is None or (now.path, now.start) != (path, start):
                if now and not whole:
                    yield now.ends()
                now = _Split(path, start)
            for record in now.add([lines[i].rstrip("\r") for i in group]):
                if whole:
                    yield record
    if now and not whole:
        yield now.ends()


def _split_fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Two scans, both split: one for the records within a split, one for the few lines at the ends of each."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(_of_splits(batches, whole=True))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, synced, before, after in _of_splits(batches, whole=False):
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start]), pa.array([synced]), pa.array([before], strings), pa.array([after], strings)], names=["path", "start", "synced", "before", "after"])

    def stitched(ends: pa.Table) -> pa.Table:
        made, held = [], []
        for end in sorted(ends.to_pylist(), key=lambda e: e["start"]):
            held += end["before"]
            if end["synced"]:
                made += records(held)
                held = end["after"]
        made += records(held)
        return pa.Table.from_batches([_record_batch(made)] if made else [], pa.schema([(c, pa.string()) for c in ("header", "seq", "qual")]))

    across = lines.mapInArrow(edges, _FRAGMENT).groupBy("path").applyInArrow(stitched, _RECORD)
    return _numbered(lines.mapInArrow(inside, _RECORD).unionByName(across)).select("read_id", "header", "seq", "qual")


def records(lines: Iterable[str]) -> Iterator[tuple[str, str, str]]:
    """(header, sequence, quality) of the lines of a FASTQ file. A quality ends where it is as long as its sequence."""
    rest = iter(lines)
    for line in rest:
        if not line.startswith("@"):
            continue
        header, seq, qual = line[1:], [], ""
        for line in rest:
            if line.startswith("+"):
                break
            seq.append(line.strip())
        whole = "".join(seq)
        while len(qual) < len(whole):
            more = next(rest, None)
            if more is None:
                break
            qual += more.strip("\r\n")
        yield header, whole, qual


def from_text(df: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Reads made of texts: letters stand for symbols in turn, blanks go, all else is no symbol."""
    seq = F.translate(F.lower(F.col(text)), LETTERS, SYMBOLS)
    return df.select(F.col(key).alias("read_id"), F.lit(None).cast("string").alias("header"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"), *extra)


def spread(df: DataFrame, by: str) -> DataFrame:
    """A table of fewer files than the session has cores, dealt out by a column, so that all of them work on it; one of more files as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), by) if len(df.inputFiles()) < cores else df


def _sliced(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number, text) of the slices of texts: new bounds in the texts' own bytes, nothing is copied."""
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    begins = np.flatnonzero((raw & 0xC0) != 0x80) if len(raw) and raw.max() >= 128 else None  # none: a byte a character
    at = ends - ends[0] if begins is None else np.searchsorted(begins, ends - ends[0])
    n = -(-np.diff(at) // size)
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(row):
        return row, number, pa.array([], pa.string())
    first = at[row] + number * size
    bounds = np.append(first if begins is None else begins[first], len(raw)) + ends[0]  # a slice ends where the next one begins
    return row, number, pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(bounds.astype(np.int64)), data).cast(pa.string())


def slices(reads: DataFrame, size: int = 100) -> DataFrame:
    """Reads cut into reads of ``size`` symbols; the last may be shorter. A slice's read_id is its read's, moved up by 31 bits, and its number: no text has more.

    They are cut in one go over a text's bytes: an expression would make the text anew for each use of it, and take time in proportion to where a slice starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in W.parts(whole, 1)):
            row, number, text = _sliced(b.column(1), size)
            home = b.column(0).take(pa.array(row))
            name = pa.array((home.fill_null(0).to_numpy(zero_copy_only=False) << 31) + number, mask=home.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([name, text], names=["read_id", "seq"])

    cut = reads.select(F.col("read_id").cast("long"), "seq").mapInArrow(run, "read_id long, seq string")
    return cut.select("read_id", F.lit(None).cast("string").alias("header"), "seq", F.lit(None).cast("string").alias("qual"))


def generated(spark: SparkSession, n: int, t: int, pa_: float | None = None, pc: float | None = None, pg: float | None = None, pt: float | None = None, seed: int = 0) -> DataFrame:
    """``t`` random reads of ``n`` symbols. Probabilities not given share what the others leave; none given: a quarter each.

    A symbol is a function of seed, read and place, so any task makes its reads anew alike.
    """
    given = [pa_, pc, pg, pt]
    used = sum(p for p in given if p is not None)
    if any(p is not None and p < 0 for p in given) or used > 1 + 1e-9 or None not in given and abs(used - 1) > 1e-9:
        raise ValueError("probabilities are not negative and sum to 1")
    share = (1 - used) / max(1, given.count(None))
    bounds, total = [], 0.0
    for p in given[:3]:
        total += share if p is None else p
        bounds.append(total)

    def at(i: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), i), 11) * F.lit(2.0**-53)
        return F.when(u < bounds[0], "A").when(u < bounds[1], "C").when(u < bounds[2], "G").otherwise("T")

    def sixteen(i: int) -> Column:
        """A hash's sixteen digits as symbols, each as likely as the others."""
        return F.translate(F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col("id"), F.lit(i))), 16, "0"), "0123456789ABCDEF", "ACGTACGTACGTACGT")

    if n > 0 and all(p is None for p in given):
        seq = F.substring(F.concat(*[sixteen(i) for i in range(-(-n // 16))]), 1, n)
    else:
        seq = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), at), "") if n > 0 else F.lit("")
    return spark.range(t).select(F.col("id").alias("read_id"), F.lit(None).cast("string").alias("header"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"))


# Measurements


def resource_log(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """``path, user_s, cpu_pct, wall, max_rss_kb`` of verbose logs of the time command: numbers 1, 3, 4 and 9 of a file, each after its colon."""
    whole = spark.read.text(file_list(spark, paths), wholetext=True).select(F.input_file_name().alias("path"), F.regexp_extract_all("value", F.lit(r"(?m): ([0-9][0-9:.]*)%?[ \t\r]*$"), 1).alias("f"))
    return whole.select("path", F.get("f", F.lit(0)).cast("double").alias("user_s"), F.get("f", F.lit(2)).cast("double").alias("cpu_pct"), F.get("f", F.lit(3)).alias("wall"), F.get("f", F.lit(8)).cast("long").alias("max_rss_kb"))


def decimal_comma_csv(spark: SparkSession, paths: str | Iterable[str], columns: str) -> DataFrame:
    """Rows between semicolons, numbers with decimal commas; ``columns`` is a schema."""
    from pyspark.sql.types import NumericType, StructType

    wanted = StructType.fromDDL(columns)
    raw = spark.read.option("sep", ";").schema(", ".join(f"`{f.name}` string" for f in wanted)).csv(file_list(spark, paths))
    return raw.select(*[(F.expr(f"try_cast(replace(trim(`{f.name}`), ',', '.') AS {f.dataType.simpleString()})") if isinstance(f.dataType, NumericType) else F.col(f"`{f.name}`")).alias(f.name) for f in wanted])


def averages(runs: DataFrame, by: tuple[str, ...] = ("tool", "n", "t", "k")) -> DataFrame:
    """Mean, least and most of each measure of the runs of a configuration."""
    measures = [c for c in ("user_s", "cpu_pct", "max_rss_kb") if c in runs.columns]
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), *[f(m).alias(f"{n}_{m}") for m in measures for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])


def side_by_side(runs: DataFrame, by: tuple[str, ...] = ("n", "t", "k"), repetition: str = "rep", repetitions: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Repetitions of a configuration as columns of one row."""
    measures = [c for c in ("user_s", "cpu_pct", "wall", "max_rss_kb") if c in runs.columns]
    return runs.groupBy(*by).agg(*[F.first(F.when(F.col(repetition) == r, F.col(m)), ignorenulls=True).alias(f"{m}_{r}") for r in repetitions for m in measures])
