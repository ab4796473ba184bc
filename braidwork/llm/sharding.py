"""Proportional stratified interleaving of a corpus into shards."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, utf8

#: Rows that one task ranks at a time, about; the square root of all rows where that is more.
ROWS_PER_BUCKET = 1024
#: Rows of a file of a shard.
FILE_ROWS = 1 << 18


def interleave(df: DataFrame, shards: int = 16, stratum: str = "source", key: tuple[str, ...] = ("doc_id", "text"), seed: int = 17) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in its shard).

    Rows of each stratum are shuffled by a seeded MD5 of their ``key`` columns and ranked; rank r
    of n stands at (r + 1/2) / n. The whole corpus sorted by that fraction repeats the mixture
    everywhere, so cutting it into equal runs gives shards whose sizes are at most one row apart
    and whose share of each stratum is that of the corpus.

    A null stratum is a stratum of its own; nulls and empty texts hash like other values. Rows equal
    in every key column may change places with each other. Empty input: no rows. Other columns pass
    through; where the input has one named shard or slot, ours replaces it.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    held = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{stratum}`").cast("string").alias("_bw_stratum"), F.md5(F.concat_ws("-", F.lit(seed), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in key])).alias("_bw_draw"))
    sizes = held.groupBy("_bw_stratum").agg(F.count("*").alias("_bw_n"))
    total = df.count()
    buckets = max(1, total // max(ROWS_PER_BUCKET, math.isqrt(total)))
    draw = (F.conv(F.substring("_bw_draw", 1, 8), 16, 10).cast("long") * buckets / 2.0**32).cast("long")
    order = ["_bw_draw"]
    ranked = running_total(held, ["_bw_stratum"], order, draw, F.lit(1), "_bw_rank", "shard-rank")
    ranked = ranked.alias("a").join(sizes.alias("b"), F.col("a._bw_stratum").eqNullSafe(F.col("b._bw_stratum"))).select("a.*", "b._bw_n")
    ranked = ranked.withColumn("_bw_at", (2 * F.col("_bw_rank") + 1) / (2.0 * F.col("_bw_n")))
    placed = running_total(ranked, [], ["_bw_at", "_bw_stratum", *order], (F.col("_bw_at") * buckets).cast("long"), F.lit(1), "_bw_place", "shard-place")
    placed = placed.withColumn("shard", F.expr(f"CAST(({shards}L * (_bw_place + 1) - 1) DIV {max(total, 1)}L AS INT)"))
    return placed.select(*[F.col(f"`{c}`") for c in names], "shard", F.expr(f"_bw_place - (shard * {total}L) DIV {shards}L").alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """The interleaved rows as one folder of Parquet files a shard; each file holds FILE_ROWS slots, in order."""
    placed = interleave(df, **options)
    placed.repartition("shard", F.expr(f"slot DIV {FILE_ROWS}")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def digest(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Sizes, checksums and places of all documents, for comparing; texts stay out of the shuffles."""
    size, crc = F.octet_length(utf8("text")).cast("long") + 1, F.crc32(utf8("text"))
    placed = interleave(documents.select("doc_id", "source", size.alias("size"), crc.alias("text_crc32")), shards, key=("doc_id", "size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of bytes, four bits at a time: the polynomial 0xEDB88320 four times for each of the sixteen values.
_NIBBLES = [(lambda c: [c := c >> 1 ^ (0xEDB88320 if c & 1 else 0) for _ in range(4)][-1])(i) for i in range(16)]
_STEP = "xor({table}[CAST(({x}) & 15 AS INTEGER) + 1], ({x}) >> 4)"


def crc_sql(text: str) -> str:
    table = "[" + ", ".join(f"{n}::BIGINT" for n in _NIBBLES) + "]"
    step = lambda x: _STEP.format(table=table, x=x)
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {step(step('xor(c, b)'))}), 4294967295)"


#: Rows equal in doc_id, size and checksum may change places; the tables have none.
SQL = f"""
WITH doc AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents
), drawn AS (
  SELECT *, md5(concat_ws('-', 17, coalesce(CAST(doc_id AS VARCHAR), 'null'), size, text_crc32)) AS draw, count(*) OVER () AS total FROM doc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM drawn
), placed AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * r + 1 AS DOUBLE) / (2::DOUBLE * n), source NULLS FIRST, draw) - 1 AS place FROM ranked
), dealt AS (
  SELECT *, (16 * (place + 1) - 1) // total AS shard FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * total) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt
"""
