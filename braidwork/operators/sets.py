"""Sets of k-mers with counters: what a count leaves, and what is made of it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kmers import canonical, is_kmer, packed_columns, spelled, word_names
from . import counting

#: How the counters of a k-mer that both sides have become one.
COUNTER_RULES = ("min", "max", "sum", "diff", "left", "right")
#: A dense histogram ends here unless told otherwise.
HISTOGRAM_END = 10_000


@dataclass(frozen=True)
class KmerSet:
    """``rows`` has each k-mer once: its words as longs (or, when made, ``kmer`` as text), and ``cnt`` long (double if weighted). The rest describes it."""

    rows: DataFrame
    k: int
    both_strands: bool = True
    min_count: int = 1
    max_count: int = (1 << 32) - 1
    counter_size: int = 4
    weighted: bool = False
    #: K-mers at most, about; None: not known. It decides about sizes of groups only.
    about: int | None = None

    def __post_init__(self) -> None:
        if "kmer" in self.rows.columns:
            object.__setattr__(self, "rows", self.rows.select(*packed_columns("kmer", self.k), "cnt"))

    @property
    def df(self) -> DataFrame:
        """``kmer`` as text, and ``cnt``."""
        return counting.in_text(self.rows, self.k)

    @property
    def words(self) -> list[str]:
        return word_names(self.k)

    # Making, keeping

    @classmethod
    def count(cls, reads: DataFrame, k: int = 25, ci: int = 2, cx: int = 1_000_000_000, cs: int = 255, both_strands: bool = True, order: str = "ACGT") -> KmerSet:
        """K-mers seen ``ci`` to ``cx`` times; counters end at ``cs``."""
        if k > 9:
            cx, cs = min(cx, (1 << 32) - 1), min(cs, (1 << 32) - 1)
        found, about = counting.count_sized(reads, k, both_strands, order)
        return cls(counting.thresholds(found, ci, cx, cs), k, both_strands, ci, cx, _bytes(min(cx, cs)), about=about)

    @classmethod
    def count_weighted(cls, reads: DataFrame, k: int = 25, ci: float = 2, cx: float = 1e9, both_strands: bool = True) -> KmerSet:
        """K-mers by the summed probability of being read right, as a float would hold it."""
        rows = counting.weighted_packed(reads, k, both_strands).where(F.col("cnt").between(ci, cx))
        return cls(rows.withColumn("cnt", F.col("cnt").cast("float").cast("double")), k, both_strands, int(ci), int(cx), 4, True)

    def write(self, path: str, buckets: int | None = None) -> None:
        """Parquet files by a hash of the k-mer's words, each in their order, and what describes the set beside them, as JSON.

        Sets of as many buckets (or of twice, four times as many) meet without a shuffle, and a lookup reads one bucket. As many
        buckets as the session has shuffle partitions, rounded up to a power of two, unless told otherwise.
        """
        spark = self.rows.sparkSession
        n = buckets or 1 << (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
        if _there(spark, path):
            raise FileExistsError(path)
        name = f"braidwork_{uuid.uuid4().hex}"
        dealt = self.rows.repartition(n, *self.words)
        dealt.write.format("parquet").option("path", f"{path}/kmers").bucketBy(n, *self.words).sortBy(*self.words).saveAsTable(name)
        total = spark.table(name).count()
        spark.sql(f"DROP TABLE {name}")  # of a table with a path the files stay
        meta = {f: getattr(self, f) for f in ("k", "both_strands", "min_count", "max_count", "counter_size", "weighted")}
        about = json.dumps(meta | {"total_kmers": total, "buckets": n})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/meta")

    @classmethod
    def read(cls, spark: SparkSession, path: str, ci: int | None = None, cx: int | None = None) -> KmerSet:
        """A written set; thresholds, if given, reach the scan."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        about = meta.pop("total_kmers")
        n, words = meta.pop("buckets"), word_names(meta["k"])
        name, by = f"braidwork_{uuid.uuid4().hex}", ", ".join(words)
        columns = ", ".join([*(f"{w} BIGINT" for w in words), f"cnt {'DOUBLE' if meta['weighted'] else 'BIGINT'}"])
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS LOCATION '{path}/kmers'")
        found = cls(spark.table(name), **meta, about=about)
        return found if ci is None and cx is None else found.with_cutoffs(ci or found.min_count, cx or found.max_count)

    # One set

    def with_cutoffs(self, ci: int, cx: int) -> KmerSet:
        """Narrower thresholds; wider ones than the set has are an error."""
        if ci < self.min_count or cx > self.max_count or ci > cx:
            raise ValueError(f"cutoffs {ci} to {cx} are not within {self.min_count} to {self.max_count}")
        return replace(self, rows=counting.thresholds(self.rows, ci, cx), min_count=ci, max_count=cx)

    def reduce(self, ci: int | None = None, cx: int | None = None, cs: int | None = None) -> KmerSet:
        ci, cx = ci or self.min_count, cx or self.max_count
        cs = cs or (1 << 8 * self.counter_size) - 1
        return replace(self, rows=counting.thresholds(self.rows, ci, cx, cs), min_count=ci, max_count=cx, counter_size=_bytes(min(cs, cx)))

    def compact(self, ci: int | None = None, cx: int | None = None) -> KmerSet:
        """Without counters: each is 1."""
        kept = counting.thresholds(self.rows, ci or self.min_count, cx or self.max_count)
        return replace(self, rows=kept.select(*self.words, F.lit(1).cast("long").alias("cnt")), counter_size=1, min_count=1, max_count=1)

    def sort(self) -> KmerSet:
        """In k-mer order, A < C < G < T, over all partitions."""
        return replace(self, rows=self.rows.orderBy(*self.words))

    def histogram(self, ci: int | None = None, cx: int | None = None, dense: bool = False) -> DataFrame:
        """``cnt, n_kmers``: how many k-mers have each count; dense: every count from ``ci`` to ``cx``, also those that none has."""
        ci = ci or self.min_count
        cx = cx or min(self.max_count, HISTOGRAM_END, (1 << 8 * self.counter_size) - 1)
        found = counting.thresholds(self.rows, ci, cx).groupBy("cnt").agg(F.count("*").alias("n_kmers"))
        if not dense:
            return found
        every = self.rows.sparkSession.range(ci, cx + 1).withColumnRenamed("id", "cnt")
        return every.join(found, "cnt", "left").select("cnt", F.coalesce("n_kmers", F.lit(0)).alias("n_kmers"))

    def size(self) -> int:
        return self.rows.count()

    def info(self) -> DataFrame:
        """What describes the set, as one row."""
        rows = self.rows.agg(F.count("*").alias("total_kmers"))
        about = {"k": self.k, "mode": int(self.weighted), "counter_size": self.counter_size, "min_count": self.min_count, "max_count": self.max_count}
        return rows.select(*[F.lit(v).cast("long").alias(n) for n, v in about.items()], "total_kmers", F.lit(self.both_strands).alias("both_strands"))

    def lookup(self, kmers: Iterable[str], canonical_form: bool = False, strict_upper: bool = False) -> DataFrame:
        """``kmer, cnt`` of each k-mer asked for; 0 where the set has it not. They are looked up as they are, in upper case."""
        asked = [x.upper() for x in kmers]
        for x in asked:
            if len(x) != self.k or set(x) - set("ACGT"):
                raise ValueError(f"{x} is no k-mer of {self.k} symbols")
        spark = self.rows.sparkSession
        if not asked:
            return spark.createDataFrame([], "kmer string, cnt long")
        rows = spark.createDataFrame([(x,) for x in asked], "asked string").withColumn("kmer", canonical("asked") if canonical_form else F.col("asked"))
        rows = rows.select("asked", *packed_columns("kmer", self.k))
        first = [_packed_number(canonical_string(x) if canonical_form else x) for x in asked]
        held = self.rows.where(F.col("w0").isin(sorted(set(first))))  # reaches the scan: one bucket of a written set for each
        if strict_upper:
            held = held.where(F.col("cnt") < self.max_count)
        return rows.join(F.broadcast(held), self.words, "left").select(F.col("asked").alias("kmer"), F.coalesce("cnt", F.lit(0)).alias("cnt"))

    def lookup_all(self, asked: DataFrame, column: str = "kmer", canonical_form: bool = False) -> DataFrame:
        """``asked`` with ``cnt``, which replaces a column of that name: any number of lookups as one join. 0 where the set has a row's k-mer not, or it is none."""
        names = [c for c in asked.columns if c != "cnt"]
        own = F.upper(F.col(f"`{column}`"))
        fits = is_kmer(own) & (F.length(own) == self.k)
        own = F.when(fits, canonical(own) if canonical_form else own)
        rows = asked.select(*[F.col(f"`{c}`") for c in names], F.struct(*packed_columns(own, self.k)).alias("_bw_asked"))
        held = self.rows.select(F.struct(*self.words).alias("_bw_held"), F.col("cnt").alias("_bw_cnt"))
        same = F.lit(True)
        for w in self.words:
            same = same & (F.col(f"_bw_asked.{w}") == F.col(f"_bw_held.{w}"))
        return rows.join(held, same, "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce("_bw_cnt", F.lit(0)).alias("cnt"))

    def contains(self, kmer: str) -> bool:
        held = self.rows.where(F.col("cnt").between(self.min_count, self.max_count))
        for w, part in zip(self.words, range(0, self.k, 31)):
            held = held.where(F.col(w) == _packed_number(kmer.upper()[part : part + 31]))
        return not held.isEmpty()

    def create_view(self, name: str) -> None:
        self.df.createOrReplaceTempView(name)

    # Two sets

    def intersect(self, other: KmerSet, rule: str = "min", **limits: int) -> KmerSet:
        """K-mers of both."""
        met = _sides(self, other, "inner")
        return _made(self, other, met.select(*self.words, _ruled(rule).alias("cnt")), **limits)

    def union(self, other: KmerSet, rule: str = "sum", **limits: int) -> KmerSet:
        """K-mers of either."""
        _alike(self, other)
        if rule in ("sum", "min", "max"):  # one shuffle of map-side aggregates
            both = self.rows.unionByName(other.rows)
            return _made(self, other, both.groupBy(*self.words).agg(getattr(F, rule)("cnt").cast("long").alias("cnt")), **limits)
        met = _sides(self, other, "full_outer")
        count = F.when(F.col("l").isNull(), F.col("r")).when(F.col("r").isNull(), F.col("l")).otherwise(_ruled(rule))
        return _made(self, other, met.select(*self.words, count.alias("cnt")), **limits)

    def kmers_subtract(self, other: KmerSet, **limits: int) -> KmerSet:
        """K-mers that the other has not."""
        _alike(self, other)
        return _made(self, other, self.rows.join(other.rows.select(*self.words), self.words, "left_anti"), **limits)

    def counters_subtract(self, other: KmerSet, rule: str = "diff", **limits: int) -> KmerSet:
        """All k-mers, with what the other's counters leave of theirs; nothing left: gone."""
        met = _sides(self, other, "left_outer")
        return _made(self, other, met.select(*self.words, F.when(F.col("r").isNull(), F.col("l")).otherwise(_ruled(rule)).alias("cnt")), **limits)

    def reverse_kmers_subtract(self, other: KmerSet, **limits: int) -> KmerSet:
        return other.kmers_subtract(self, **limits)

    def reverse_counters_subtract(self, other: KmerSet, rule: str = "diff", **limits: int) -> KmerSet:
        return other.counters_subtract(self, rule, **limits)

    def same_as(self, other: KmerSet) -> bool:
        """Whether both have the same k-mers with the same counters."""
        return self.differences(other).isEmpty()

    def differences(self, other: KmerSet) -> DataFrame:
        """Words and both counters, ``l`` and ``r``, of k-mers whose counters differ."""
        return _sides(self, other, "full_outer").where("NOT (l <=> r)")


def canonical_string(kmer: str) -> str:
    return min(kmer, kmer[::-1].translate(str.maketrans("ACGT", "TGCA")))


def _bytes(top: int) -> int:
    """Bytes that a counter to ``top`` takes, 1 to 4."""
    return min(4, max(1, (int(top).bit_length() + 7) // 8))


def _alike(a: KmerSet, b: KmerSet) -> None:
    if a.k != b.k:
        raise ValueError(f"sets of {a.k}-mers and {b.k}-mers do not go together")
    if a.weighted or b.weighted:
        raise ValueError("weighted sets take no part in set operations")


def _sides(a: KmerSet, b: KmerSet, how: str) -> DataFrame:
    _alike(a, b)
    return a.rows.select(*a.words, F.col("cnt").alias("l")).join(b.rows.select(*b.words, F.col("cnt").alias("r")), a.words, how)


def _ruled(rule: str, l: Column | None = None, r: Column | None = None) -> Column:  # noqa: E741
    l, r = F.col("l") if l is None else l, F.col("r") if r is None else r  # noqa: E741
    if rule not in COUNTER_RULES:
        raise ValueError(f"a counter rule is one of {', '.join(COUNTER_RULES)}")
    return {"min": F.least, "max": F.greatest, "sum": lambda a, b: a + b, "diff": lambda a, b: a - b, "left": lambda a, b: a, "right": lambda a, b: b}[rule](l, r)


#: The rule of an operation that is given none.
DEFAULT_RULES = {"intersect": "min", "union": "sum", "counters_subtract": "diff", "reverse_counters_subtract": "diff"}


def combined(operation: str, rule: str | None, l: Column, r: Column) -> Column:  # noqa: E741
    """What an operation leaves of two counters, of which either may be null: absent."""
    if "kmers_subtract" in operation and rule:
        raise ValueError(f"{operation} has no counter rule")
    if operation.startswith("reverse_"):
        return combined(operation.removeprefix("reverse_"), rule, r, l)
    both = l.isNotNull() & r.isNotNull()
    if operation == "kmers_subtract":
        return F.when(r.isNull(), l)
    met = _ruled(rule or DEFAULT_RULES[operation], l, r)
    return {"intersect": F.when(both, met), "union": F.when(both, met).otherwise(F.coalesce(l, r)), "counters_subtract": F.when(both, met).otherwise(l)}[operation]


@dataclass(frozen=True)
class Limits:
    """Thresholds and counters' bytes of what an operation makes."""

    ci: int
    cx: int
    cs: int
    size: int

    def of(self, count: Column) -> Column:
        """A counter within the thresholds, cut to the most that it may be; else null."""
        return F.when(count.between(max(self.ci, 1), self.cx), F.least(count, F.lit(self.cs).cast("long")))


def limits_of(a: KmerSet | Limits, b: KmerSet | Limits, ci: int | None = None, cx: int | None = None, cs: int | None = None) -> Limits:
    """As given, or else the wider of both inputs'; counters as long as the longer's."""
    a, b = ((x.ci, x.cx, x.size) if isinstance(x, Limits) else (x.min_count, x.max_count, x.counter_size) for x in (a, b))
    ci, cx, cs = ci or min(a[0], b[0]), cx or max(a[1], b[1]), cs or (1 << 8 * max(a[2], b[2])) - 1
    return Limits(ci, cx, cs, _bytes(min(cs, cx)))


def _made(a: KmerSet, b: KmerSet, rows: DataFrame, ci: int | None = None, cx: int | None = None, cs: int | None = None) -> KmerSet:
    x = limits_of(a, b, ci, cx, cs)
    return KmerSet(counting.thresholds(rows, max(x.ci, 1), x.cx, x.cs), a.k, a.both_strands or b.both_strands, x.ci, x.cx, x.size)


def grouped(sets: dict[str, KmerSet]) -> DataFrame:
    """The words of each k-mer of any of the sets and its counter in each, a column a set under its name, null where it is absent: one shuffle for all of them."""
    first = next(iter(sets.values()))
    for other in sets.values():
        _alike(first, other)
    tagged = None
    for i, s in enumerate(sets.values()):
        rows = s.rows.select(*s.words, F.lit(i).alias("_bw_set"), "cnt")
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy(*first.words).agg(*[F.max(F.when(F.col("_bw_set") == i, F.col("cnt"))).alias(n) for i, n in enumerate(sets)])


@dataclass(frozen=True)
class Output:
    """One of several outcomes of :func:`simple`."""

    operation: str
    rule: str | None = None
    ci: int | None = None
    cx: int | None = None
    cs: int | None = None


def simple(a: KmerSet, b: KmerSet, outputs: dict[str, Output]) -> DataFrame:
    """``output, kmer, cnt``: several operations on two sets in one pass: both are grouped once, and fanned out."""
    l, r = F.col("l"), F.col("r")  # noqa: E741
    made = []
    for name, o in outputs.items():
        count = limits_of(a, b, o.ci, o.cx, o.cs).of(combined(o.operation, o.rule, l, r))
        made.append(F.struct(F.lit(name).alias("output"), count.alias("cnt")))
    opened = grouped({"l": a, "r": b}).select(*a.words, F.inline(F.array(*made))).where("cnt IS NOT NULL")
    return opened.select("output", spelled(a.k).alias("kmer"), "cnt")


def _packed_number(part: str) -> int:
    """The first word of a k-mer given as text; -1, which no k-mer has, if it is none."""
    n = 0
    for c in part[:31]:
        if c not in "ACGT":
            return -1
        n = 4 * n + "ACGT".index(c)
    return n


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
