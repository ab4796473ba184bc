"""Text forms of sets, histograms and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.counting import thresholds


def _write(lines: DataFrame, path: str, mode: str, compression: str = "none") -> None:
    lines.write.mode(mode).option("compression", compression).text(path)


def dump_lines(counts: DataFrame, ci: int = 1, cx: int | None = None, separator: str = "\t", weighted: bool = False, in_order: bool = False) -> DataFrame:
    """``value``: a k-mer and its counter a line; weights with six decimals."""
    kept = thresholds(counts, ci, cx)
    kept = kept.orderBy("kmer") if in_order else kept
    count = F.format_string("%.6f", F.col("cnt").cast("double")) if weighted else F.col("cnt").cast("string")
    return kept.select(F.concat(F.col("kmer"), F.lit(separator), count).alias("value"))


def dump(counts: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    _write(dump_lines(counts, **options), path, mode)


def fasta_count_lines(counts: DataFrame, numbered: bool = False) -> DataFrame:
    """``value``: k-mers as FASTA records, headed by their counts or, ``numbered``, by 1, 2, 3 and so on in k-mer order."""
    if not numbered:
        return counts.select(F.format_string(">%d\n%s", F.col("cnt"), F.col("kmer")).alias("value"))
    rows = counts.select("kmer").orderBy("kmer").select("kmer", F.monotonically_increasing_id().alias("_id"))
    rows = rows.select("kmer", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at"))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").select(F.format_string(">%d\n%s", F.col("_start") + F.col("_at") + 1, F.col("kmer")).alias("value"))


def histogram_lines(histogram: DataFrame) -> DataFrame:
    return histogram.orderBy("cnt").select(F.concat_ws("\t", F.col("cnt").cast("string"), F.col("n_kmers").cast("string")).alias("value"))


def write_histogram(histogram: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _write(histogram_lines(histogram), path, mode)


def read_lines(reads: DataFrame, kind: str = "fastq") -> DataFrame:
    """``value``: a record of a read. FASTQ reads may become FASTA; the other way round there are no qualities, an error."""
    header = F.coalesce("header", F.col("read_id").cast("string"))
    if kind == "fasta":
        return reads.select(F.concat(F.lit(">"), header, F.lit("\n"), F.col("seq")).alias("value"))
    if kind != "fastq":
        raise ValueError("kind is fasta or fastq")
    lost = F.raise_error(F.lit("a read without qualities cannot be written as FASTQ"))
    return reads.select(F.concat(F.lit("@"), header, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.coalesce(F.col("qual"), lost.cast("string"))).alias("value"))


def write_reads(reads: DataFrame, path: str, kind: str = "fastq", mode: str = "errorifexists", compression: str = "none") -> None:
    """Text files; ``compression`` may be gzip or bzip2."""
    _write(read_lines(reads, kind), path, mode, compression)


def summary_json(statistics: DataFrame) -> DataFrame:
    """``value``: the one row of a run's statistics as JSON."""
    return statistics.select(F.to_json(F.struct("*")).alias("value"))


def append_csv(runs: DataFrame, path: str) -> None:
    """Measurements as rows between semicolons, with decimal commas, added to what is there."""
    doubles = {n for n, kind in runs.dtypes if kind in ("double", "float")}
    out = runs.select(*[F.translate(F.col(c).cast("string"), ".", ",").alias(c) if c in doubles else c for c in runs.columns])
    out.write.mode("append").option("sep", ";").csv(path)
