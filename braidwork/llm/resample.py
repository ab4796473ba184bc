"""Importance resampling towards a target corpus: inverted postings by bucket, gains bucket by bucket, sums by document."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_key
from .exchange import packed, unpacked
from .sharding import crc_sql

#: Buckets of features, ranges of them that postings are dealt by, and the longest run of words that is a feature.
BUCKETS, PARTS, LONGEST = 10_000, 8, 3
_RANGE = BUCKETS // PARTS
#: Features of a chunk of documents, about (a longer text is a chunk of its own), and chunks whose postings of a range one task reads, about.
CHUNK_FEATURES, SLICE_CHUNKS = 450_000, 64
#: Bytes of a text that are split at a time.
PIECE_BYTES = 1 << 20
#: ASCII letters are lowered; ASCII signs that are neither letter nor digit part words.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_ASKED = "chunk long, part int, sizes binary, docs binary, times binary, rows array<struct<key:{kind},a:bigint,b:bigint,n_words:bigint,n_features:bigint>>"


def buckets_of(text: bytes | None) -> tuple[np.ndarray, int]:
    """The bucket of each run of one to LONGEST words of a whole text, repeats included; and how many words it has.

    A checksum goes on from that of the run without its last word, so no run is put together.
    """
    clean, at, n_words, found = (text or b"").translate(_PLAIN), 0, 0, []
    last: list[list[int]] = [[] for _ in range(LONGEST - 1)]  # checksum of the run of each length that ends in the last word so far
    while at < len(clean):
        end = clean.find(b" ", at + PIECE_BYTES)
        end = len(clean) if end < 0 else end
        words = clean[at:end].split()
        at = end
        if not words:
            continue
        n_words += len(words)
        spaced = [b" " + w for w in words]
        sums = list(map(crc32, words))
        found.append(sums)
        for n in range(LONGEST - 1):
            before = last[n] + sums  # runs of n + 1 words, each but the final one followed by a word
            last[n] = before[-1:]
            sums = list(map(crc32, spaced[len(spaced) - len(before) + 1 :], before))
            found.append(sums)
    if not n_words:
        return np.zeros(0, dtype=np.int64), 0
    return np.concatenate([np.array(s, dtype=np.int64) for s in found if s]) % BUCKETS, n_words


class _Chunk:
    """Documents whose postings go out together."""

    def __init__(self) -> None:
        self.about: list[list[pa.Array]] = []
        self.bucket: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.words: list[int] = []
        self.features: list[int] = []
        self.held = 0

    def add(self, text: bytes | None) -> None:
        found, words = buckets_of(text)
        bucket, times = np.unique(found, return_counts=True)
        self.bucket.append(bucket)
        self.times.append(times)
        self.words.append(words)
        self.features.append(len(found))
        self.held += len(found)

    def batch(self, number: int) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(self.bucket)), [len(b) for b in self.bucket])
        bucket, times = np.concatenate(self.bucket), np.concatenate(self.times)
        order = np.argsort(bucket, kind="stable")
        bucket, doc, times = bucket[order], doc[order], times[order]
        size = np.bincount(bucket, minlength=BUCKETS)
        ends = np.cumsum(size)
        step = np.diff(doc, prepend=0)
        starts = (ends - size)[size > 0]
        step[starts] = doc[starts]
        cut = [0, *ends[_RANGE - 1 :: _RANGE]]
        pack = lambda x: packed(x.astype(np.uint32))
        sent = [(pack(size[p * _RANGE : (p + 1) * _RANGE]), pack(step[cut[p] : cut[p + 1]]), pack(times[cut[p] : cut[p + 1]])) for p in range(PARTS)]
        parts = [*zip(*sent)]
        fields = [*(pa.concat_arrays([a[i] for a in self.about]) for i in range(3)), pa.array(self.words, pa.int64()), pa.array(self.features, pa.int64())]
        rows = pa.StructArray.from_arrays(fields, names=["key", "a", "b", "n_words", "n_features"])
        lists = pa.ListArray.from_arrays(pa.array([0] * (PARTS + 1) + [len(rows)], pa.int32()), rows)
        columns = [pa.array([*p, None], pa.binary()) for p in parts]
        return pa.RecordBatch.from_arrays([pa.array([number] * (PARTS + 1), pa.int64()), pa.array([*range(PARTS), -1], pa.int32()), *columns, lists], names=["chunk", "part", "sizes", "docs", "times", "rows"])


def _postings(texts: DataFrame, name: str) -> DataFrame:
    """Of (key, a, b, task, text): chunks of documents turned into postings, a row for each range of buckets, and one (range -1) about the documents.

    A row's postings are ordered by bucket and document: how many each bucket has, each one's document by the
    difference to the one before, and how often the bucket's features occur in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = _Chunk(), 0
        for batch in batches:
            begun = 0
            for i, (task, text) in enumerate(zip(batch.column(3), batch.column(4))):
                now.add(text.as_py())
                if now.held >= CHUNK_FEATURES:
                    now.about.append(batch.slice(begun, i + 1 - begun).columns[:3])
                    yield now.batch((task.as_py() << 33) + number)
                    now, number, begun = _Chunk(), number + 1, i + 1
            if begun < batch.num_rows:
                now.about.append(batch.slice(begun).columns[:3])
                last = batch.column(3)[0].as_py()
        if now.words:
            yield now.batch((last << 33) + number)

    return materialize(texts.mapInArrow(run, _ASKED.format(kind=texts.schema["key"].dataType.simpleString())), name)


def _opened(sizes: bytes, docs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket in its range, document in its chunk, times) of each posting."""
    size = unpacked(sizes, "u4").astype(np.int64)
    step, bucket = unpacked(docs, "u4").astype(np.int64), np.repeat(np.arange(len(size)), size)
    doc = np.cumsum(step)
    first = (np.cumsum(size) - size)[bucket]  # of each posting's bucket
    return bucket, doc - (doc[first] - step[first]), unpacked(times, "u4").astype(np.int64)


def _totals(postings: DataFrame, out: str) -> DataFrame:
    """``bucket, <out>``: the features of each bucket in a whole corpus, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for part, sizes, times in zip(*(c.to_pylist() for c in b.columns)):
                bucket = np.repeat(np.arange(_RANGE), unpacked(sizes, "u4"))
                np.add.at(total, part * _RANGE + bucket, unpacked(times, "u4").astype(np.int64))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    found = postings.where("part >= 0").select("part", "sizes", "times").mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias(out))


def gains(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target and in the corpus, both smoothed by one a bucket; floors."""
    held = [math.floor(1000 * math.log((float(y) + 1) * (float(all_s) + BUCKETS) / ((float(x) + 1) * (float(all_t) + BUCKETS)))) for x, y in zip(s.tolist(), t.tolist())]
    return np.array(held, dtype=np.int64)


def weighted(documents: DataFrame, target: DataFrame, seed: int = 42, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``key, a, b, n_words, n_features, weight, score``, a row a document; a and b are hashes of its text.

    Postings are dealt by a range of buckets and a slice of the chunks, so that a bucket which all documents have is
    many tasks' work. Each meets its buckets' counts in both corpora, gives them gains, and sends each document of a
    chunk the sum of what its postings there contribute.
    """
    texts = documents.select(F.col(f"`{key}`").alias("key"), *[h.alias(n) for h, n in zip(text_key(F.col(f"`{text}`")), "ab")], F.spark_partition_id().alias("task"), F.col(f"`{text}`").cast("binary").alias("text"))
    wanted = target.select(F.lit(0).alias("key"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.spark_partition_id().alias("task"), F.col(f"`{target_text}`").cast("binary").alias("text"))
    postings = _postings(texts, "resample-postings")
    both = _totals(postings, "s").withColumn("t", F.lit(0).cast("long")).unionByName(_totals(_postings(wanted, "resample-target"), "t").withColumn("s", F.lit(0).cast("long")))
    totals = materialize(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "resample-totals")  # BUCKETS rows at most
    all_s, all_t = totals.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    slices = max(1, -(-postings.where("part = -1").count() // SLICE_CHUNKS))

    def contribute(asking: pa.Table, told: pa.Table) -> pa.Table:
        s, t = np.zeros(_RANGE, dtype=np.int64), np.zeros(_RANGE, dtype=np.int64)
        at = told["bucket"].to_numpy() % _RANGE
        s[at], t[at] = told["s"].to_numpy(), told["t"].to_numpy()
        gain = gains(s, t, all_s, all_t)
        chunk, doc, weight = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for number, *sent in zip(*(asking[c].to_pylist() for c in ("chunk", "sizes", "docs", "times"))):
            bucket, row, times = _opened(*sent)
            if not len(row):
                continue
            total = np.zeros(row.max() + 1, dtype=np.int64)
            np.add.at(total, row, gain[bucket] * times)
            met = np.flatnonzero(np.bincount(row))
            chunk.append(np.full(len(met), number))
            doc.append(met.astype(np.int32))
            weight.append(total[met])
        return pa.table({"chunk": np.concatenate(chunk), "at": np.concatenate(doc), "weight": np.concatenate(weight)})

    where = ["part", "slice"]
    asking = postings.where("part >= 0").select("part", F.pmod(F.xxhash64("chunk"), F.lit(slices)).cast("int").alias("slice"), "chunk", "sizes", "docs", "times")
    told = totals.select(F.expr(f"bucket DIV {_RANGE}").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "bucket", "s", "t")
    sums = asking.groupBy(*where).cogroup(told.groupBy(*where)).applyInArrow(contribute, "chunk long, at int, weight long")
    about = postings.where("part = -1").select("chunk", F.posexplode("rows").alias("at", "row")).select("chunk", "at", "row", F.lit(0).cast("long").alias("weight"))
    kind = postings.schema["rows"].dataType.elementType.simpleString()
    rows = about.unionByName(sums.withColumn("row", F.lit(None).cast(kind)))
    rows = rows.groupBy("chunk", "at").agg(F.first("row", ignorenulls=True).alias("row"), F.sum("weight").alias("weight")).select("row.*", "weight")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def importance(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, **options) -> DataFrame:
    """``key, a, b, n_words, n_features, weight, score, rank``: of the documents of ``least_words`` words or more, ``percent`` in a hundred are drawn, those of the highest scores.

    A score is a document's log importance under hashed runs of one to three words, in thousandths, with seeded Gumbel
    noise; ties go to the lesser key. A rank is null where a document is not drawn. Null and empty texts have no features
    and weigh nothing; very long texts count whole. Rows that repeat are documents each, which draw the same
    noise. A null key draws as the empty one and comes last among equals. No target: all gains come of smoothing alone.
    Empty input: no rows. Other columns do not matter, whatever their names.
    """
    rows = materialize(weighted(documents, target, **options), "resample-scored")
    able = rows.where(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    # in order over all partitions, and written: a place is one of a partition and one in it
    order = [F.desc("score"), F.asc_nulls_last("key"), "a", "b"]
    placed = materialize(able.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "resample-sorted")
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    ranked = placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_at") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return ranked.select(*rows.columns, "rank").unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn documents with all their columns, and ``weight``, ``score`` and ``rank``, which replace columns of these names.

    Rows that repeat are drawn as often as they have ranks.
    """
    drawn = importance(documents, target, key=key, text=text, **options).where("rank IS NOT NULL").select("key", "a", "b", "weight", "score", "rank").alias("d")
    rows = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in ("weight", "score", "rank")], *[h.alias(f"_bw_{n}") for h, n in zip(text_key(F.col(f"`{text}`")), "ab")])
    same = F.col(f"c.`{key}`").eqNullSafe(F.col("d.key")) & (F.col("c._bw_a") == F.col("d.a")) & (F.col("c._bw_b") == F.col("d.b"))
    once = rows.alias("c").join(drawn, same, "left_semi").dropDuplicates([key, "_bw_a", "_bw_b"])
    return once.alias("c").join(drawn, same).select(*[F.col(f"c.`{c}`") for c in rows.columns if not c.startswith("_bw_")], "d.weight", "d.score", "d.rank")


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return importance(documents, benchmark).select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


def _features_sql(table: str) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
    runs = "list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
    return f"SELECT *, {runs} AS f FROM (SELECT *, {words} AS w FROM {table})"


#: Of the documents' rows one by one; checksums are taken once for each feature.
SQL = f"""
WITH doc AS MATERIALIZED ({_features_sql("documents")}), item AS MATERIALIZED ({_features_sql("benchmark")}),
doc_count AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(f) AS f FROM doc) GROUP BY doc_id, f),
item_count AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest(f) AS f FROM item) GROUP BY f),
place AS MATERIALIZED (SELECT f, {crc_sql("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM doc_count UNION SELECT f FROM item_count)),
s AS (SELECT bucket, sum(n) AS s FROM doc_count JOIN place USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM item_count JOIN place USING (f) GROUP BY bucket),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM doc_count JOIN place USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM doc LEFT JOIN weight USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (SELECT 5 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END AS rank FROM placed
"""
