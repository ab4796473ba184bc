"""Counts over reads that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.kmers import spelled, word_names
from ..operators.counting import packed_kmers, schema_of, thresholds


def streamed_lines(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Reads of files that appear in a folder, a line each; headers are passed over. A batch takes so many files at most (not said: all that are there)."""
    source = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    lines = source.text(path).where("value <> '' AND NOT startswith(value, '>')")
    return lines.select(F.lit(None).cast("long").alias("read_id"), F.rtrim("value").alias("seq"))


def count_stream(reads: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """``kmer, cnt`` so far; only k-mers of new reads change."""
    return packed_kmers(reads, k, both_strands).groupBy(*word_names(k)).agg(F.sum("n").alias("cnt")).select(spelled(k).alias("kmer"), "cnt")


def write_counts(counts: DataFrame, path: str, checkpoint: str, ci: int = 2, cx: int | None = None, cs: int | None = None) -> StreamingQuery:
    """Keeps a folder of Parquet files up to date with what the thresholds leave, all of it in a subfolder each batch of input; for few k-mers."""
    return _started(counts, "complete", path, checkpoint, ci, cx, cs)


def write_changes(counts: DataFrame, path: str, checkpoint: str, ci: int = 2, cx: int | None = None, cs: int | None = None) -> StreamingQuery:
    """Adds the counts that a batch of input has changed, as far as the thresholds leave them, in a subfolder each.

    What is written grows with what changes, not with all that has been counted. A k-mer's row of the last
    subfolder is its count (:func:`latest`).
    """
    return _started(counts, "update", path, checkpoint, ci, cx, cs)


def _started(counts: DataFrame, mode: str, path: str, checkpoint: str, ci: int, cx: int | None, cs: int | None) -> StreamingQuery:
    """A batch that is run again after a failure replaces what it had written."""

    def write(batch: DataFrame, number: int) -> None:
        thresholds(batch, ci, cx, cs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """``kmer, cnt`` as the batches of :func:`write_changes` have left them."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy("kmer").agg(F.max_by("cnt", "batch").alias("cnt"))


def frequent_stream(reads: DataFrame, k: int, least: int = 2, both_strands: bool = True) -> DataFrame:
    """``kmer, cnt``: each k-mer once, in the batch in which its count comes to ``least``, with its count by then.

    A k-mer's count is kept in the state store under its words, and no longer touched once it has been sent out.
    """
    words = word_names(k)

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        if before >= least:
            for _ in rows:  # they must be taken
                pass
            return
        now = before + sum(int(r["n"].sum()) for r in rows)
        state.update((now,))
        if now >= least:
            yield pd.DataFrame([(*key, now)], columns=[*words, "cnt"])

    found = packed_kmers(reads, k, both_strands).groupBy(*words).applyInPandasWithState(run, schema_of(k, "cnt long"), "cnt long", "append", GroupStateTimeout.NoTimeout)
    return found.select(spelled(k).alias("kmer"), "cnt")


def write_frequent(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what :func:`frequent_stream` sends out to a folder of Parquet files, each row once, restarts included."""
    return found.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
