"""Shared pieces: session settings, intermediate tables in shared storage, connected components."""

from __future__ import annotations

import atexit
import ctypes
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset and Spark runs on one machine, as in tests.
FALLBACK_CHECKPOINT_DIR = "file:///tmp/checkpoints"
#: Bytes that go to Python at a time, about; texts are long, and a batch is held on both sides.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For rows that hold packed numbers: pages end after about 1 MB, not after 100 such rows, and nothing is packed twice.
_LARGE_ROWS = {"compression": "none", "parquet.page.size.row.check.min": "1"}
#: Links whose components one task works out.
EDGES_PER_TASK = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; sets a folder of our own only where it is unset.

    On a cluster no folder of one machine will do, so there it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", FALLBACK_CHECKPOINT_DIR)
        root = FALLBACK_CHECKPOINT_DIR
    return root.rstrip("/")


@contextmanager
def _session_setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def bound_batches(spark: SparkSession) -> None:
    """From now on in this session, batches that go to Python are bounded by bytes, not only by rows."""
    if int(spark.conf.get(_BATCH).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """``df`` written once to shared storage and read back. ``large``: its rows hold packed numbers, of 100 KB or more.

    The lineage ends in files that every executor and the driver can read, so a lost executor
    costs a re-read, never a recomputation with another outcome. Shuffle files of the write are
    dropped as soon as it has succeeded.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/braidwork/{name}-{uuid.uuid4().hex}"
    bound_batches(spark)
    with _session_setting(spark, _CLEANUP, "true"):
        df.write.options(**(_LARGE_ROWS if large else {})).parquet(path)
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives what a Python worker has freed back to the machine; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def discard(df: DataFrame) -> None:
    """Deletes a table of :func:`materialize` that nothing will read again."""
    for spark, path in [w for w in _written if any(w[1].rpartition("/")[2] in f for f in df.inputFiles()[:1])]:
        _delete(spark, path)
        _written.remove((spark, path))


def written() -> int:
    """How many tables of :func:`materialize` there are; for :func:`discard_since`."""
    return len(_written)


def discard_since(mark: int, keep: DataFrame) -> None:
    """Deletes the tables written since ``mark`` but for ``keep``, which nothing else of them is needed for."""
    kept = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()}
    for spark, path in _written[mark:]:
        if path.rpartition("/")[2] not in kept:
            _delete(spark, path)
            _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str | Column) -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("binary"), F.lit(b""))


def text_key(text: str | Column = "text") -> list[Column]:
    """Two 64-bit hashes that stand for a text wherever rows of one doc_id must be told apart."""
    text = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def running_total(df: DataFrame, group: list[str], order: list[str], bucket: Column, value: Column, out: str, name: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before, in its group, by bucket and then ``order``.

    ``bucket`` must rise with ``order``. Only the sums of the buckets are added up across a group,
    so that a group of any size is spread over as many tasks as it has buckets.
    """
    rows = df.withColumn("_bw_bucket", bucket).withColumn("_bw_value", value.cast("long"))
    sums = materialize(rows.groupBy(*group, "_bw_bucket").agg(F.sum("_bw_value").alias("_bw_sum")), name)
    before = Window.partitionBy(*group).orderBy("_bw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_bw_start", F.coalesce(F.sum("_bw_sum").over(before), F.lit(0))).drop("_bw_sum")
    inside = Window.partitionBy(*group, "_bw_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_bw_inside", F.coalesce(F.sum("_bw_value").over(inside), F.lit(0)))
    left, right = rows.alias("l"), starts.alias("r")
    same = F.lit(True)
    for key in (*group, "_bw_bucket"):
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    joined = left.join(right, same, "inner")
    kept = [F.col(f"l.{c}") for c in df.columns]
    return joined.select(*kept, (F.col("l._bw_inside") + F.col("r._bw_start")).alias(out))


class Forest:
    """Labels of rows; each is the least row linked so far. Equal labels in a run of rows are seen at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.renew()

    def renew(self) -> None:
        self.turns = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else self.label

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j = i[open_], j[open_]
            np.minimum.at(label, np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_]))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        self.label = label
        self.renew()

    def one(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Whether all rows of both runs have one label."""
        t = self.turns
        return (t[a0] == t[a1 - 1]) & (t[b0] == t[b1 - 1]) & (self.label[a0] == self.label[b0])


def _solved(edges: DataFrame) -> DataFrame:
    """``node, component`` of edges that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            ends = np.concatenate([np.concatenate(x) for x in zip(*held)])
            node, at = np.unique(ends, return_inverse=True)
            forest = Forest(len(node))
            forest.join(at[: len(at) // 2], at[len(at) // 2 :])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[forest.label])], names=["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of each node of ``edges`` (src, dst: long); the component is its least node.

    As many edges as one task can hold are solved there. More go through alternating large-star and
    small-star steps. Each minimum is aggregated map-side and written before it is joined back, so that
    both sides of each join are plain exchanges and the runtime can split a hub that holds a large
    share of the edges.
    """
    high, low = F.greatest("src", "dst"), F.least("src", "dst")
    now = materialize(edges.where("src <> dst").select(high.alias("u"), low.alias("v")).distinct(), "cc-start")
    state = _fingerprint(now)
    while state[0] > EDGES_PER_TASK:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-large-min")
        big = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        least = materialize(big.groupBy("u").agg(F.min("v").alias("m")), "cc-small-min")
        moved = big.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        state, before = _fingerprint(now), state
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return _solved(now)


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    n, x = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return n, x or 0
