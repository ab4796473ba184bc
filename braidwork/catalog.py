"""Queries over the driver's tables, by name, and SQL with the same rows.

Texts become reads letter by letter, the same way in both. Sets of k-mers are those of texts of one
language or of the others; those of queries named whole_... are of all texts.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kmers as K
from .operators import bins, counting, reads as R, segments
from .operators.sets import COUNTER_RULES, KmerSet, Output, simple
from .plans.expression import evaluate, parse_definition
from .sources import readers, writers
from .streaming.counting import count_stream, frequent_stream, latest, streamed_lines, write_changes, write_frequent

LONG_K, SET_K, SLICE_K, P = 21, 11, 15, 7
def _reads(spark: SparkSession, d: str) -> DataFrame:
    return readers.from_text(readers.spread(spark.read.parquet(f"{d}/documents.parquet"), "doc_id"), extra=("lang",))


def _slices(spark: SparkSession, d: str) -> DataFrame:
    return readers.slices(_reads(spark, d), 100)


def _few(spark: SparkSession, d: str) -> DataFrame:
    """Some of the reads, for surveys, drawn before texts are made reads."""
    return readers.from_text(spark.read.parquet(f"{d}/documents.parquet").sample(bins.SHARE, seed=7))


def _set(spark: SparkSession, d: str, english: bool | None, k: int = SET_K, ci: int = 1, cs: int = 255) -> KmerSet:
    """Of the English texts, the others, or (None) all."""
    reads = _reads(spark, d)
    if english is None:
        return KmerSet.count(reads, k, ci=ci, cs=cs)
    return KmerSet.count(reads.where(F.col("lang") == "en" if english else F.col("lang") != "en"), k, ci=ci, cs=cs)


def _both(spark: SparkSession, d: str) -> tuple[KmerSet, KmerSet]:
    return _set(spark, d, True), _set(spark, d, False)


def _weighted(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    cut = _reads(spark, d).where("length(seq) > 0") if whole else _slices(spark, d)
    qual = F.array_join(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.char(33 + (F.col("read_id") * 31 + i * 7) % 41)), "")
    return cut.withColumn("qual", qual)


#: Measured runs, made of line items; their numbers are quarters and halves, whose sums are exact.
_RUN_SQL = "SELECT l_returnflag AS tool, CAST(l_linenumber AS INT) AS n, CAST(l_orderkey % 5 AS BIGINT) AS t, CAST(l_partkey % 3 AS INT) AS k, CAST(l_suppkey % 3 + 1 AS INT) AS rep, CAST((l_orderkey % 1000) * 0.25 AS DOUBLE) AS user_s, CAST((l_partkey % 400) * 0.5 AS DOUBLE) AS cpu_pct, CAST(l_orderkey + l_suppkey AS BIGINT) AS max_rss_kb FROM {0}"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_RUN_SQL.format("{items}"), items=spark.read.parquet(f"{d}/lineitem.parquet"))


# SQL

_READS = f"reads AS (SELECT doc_id AS read_id, lang, translate(lower(text), '{readers.LETTERS}', '{readers.SYMBOLS}') AS seq FROM documents)"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _sql_lesser(x: str, order: str = "ACGT") -> str:
    if order == "ACGT":
        return f"least({x}, {_RC.format(x)})"
    return f"CASE WHEN translate({x}, '{order}', '0123') <= translate({_RC.format(x)}, '{order}', '0123') THEN {x} ELSE {_RC.format(x)} END"


def _sql_kmers(k: int, name: str = "kmers", where: str = "true", both: bool = True, order: str = "ACGT") -> str:
    f = f"substr(run, i, {k})"
    return f"""{name}_run AS (SELECT unnest(regexp_split_to_array(seq, '[^ACGT]+')) AS run FROM reads WHERE {where}),
{name}_at AS (SELECT run, unnest(range(1, length(run) - {k} + 2)) AS i FROM {name}_run WHERE length(run) >= {k}),
{name}_f AS (SELECT {f} AS f FROM {name}_at),
{name} AS (SELECT {_sql_lesser("f", order) if both else "f"} AS kmer FROM {name}_f)"""


def _sql_counts(k: int, name: str = "counts", **options) -> str:
    return f"{_sql_kmers(k, name + '_k', **options)}, {name} AS (SELECT kmer, count(*) AS cnt FROM {name}_k GROUP BY kmer)"


def _counted(k: int, select: str, **options) -> str:
    return f"WITH {_READS}, {_sql_counts(k, **options)} {select}"


def _sets_sql(k: int) -> str:
    return f"{_READS}, {_sql_counts(k, 'a0', where=chr(39).join(['lang = ', 'en', '']))}, a AS MATERIALIZED (SELECT kmer, least(cnt, 255) AS cnt FROM a0), {_sql_counts(k, 'b0', where=chr(39).join(['lang <> ', 'en', '']))}, b AS MATERIALIZED (SELECT kmer, least(cnt, 255) AS cnt FROM b0)"


_SETS = _sets_sql(SET_K)
_RULE = {"min": "least(a.cnt, b.cnt)", "max": "greatest(a.cnt, b.cnt)", "sum": "a.cnt + b.cnt", "diff": "a.cnt - b.cnt", "left": "a.cnt", "right": "b.cnt"}


def _sql_pair(how: str, count: str, a: str = "a", b: str = "b") -> str:
    join = {"inner": "JOIN", "full": "FULL JOIN", "left": "LEFT JOIN"}[how]
    return f"SELECT kmer, least(CAST(cnt AS BIGINT), 255) AS cnt FROM (SELECT coalesce(a.kmer, b.kmer) AS kmer, {count} AS cnt FROM {a} a {join} {b} b ON a.kmer = b.kmer) WHERE cnt BETWEEN 1 AND 4294967295"


def _sql_union(rule: str) -> str:
    return _sql_pair("full", f"CASE WHEN b.kmer IS NULL THEN a.cnt WHEN a.kmer IS NULL THEN b.cnt ELSE {_RULE[rule]} END")


def _sql_left(rule: str) -> str:
    return _sql_pair("left", f"CASE WHEN b.kmer IS NULL THEN a.cnt ELSE {_RULE[rule]} END")


_SLICES = "slices AS (SELECT read_id * 2147483648 + s AS read_id, substr(seq, s * 100 + 1, 100) AS seq FROM (SELECT read_id, seq, unnest(range(0, (length(seq) - 1) // 100 + 1)) AS s FROM reads WHERE length(seq) > 0))"
_KEPT = f"{_READS}, {_sql_counts(SLICE_K, 'c0', where=chr(39).join(['lang = ', 'en', '']))}, kept AS (SELECT kmer, least(cnt, 255) AS cnt FROM c0 WHERE cnt >= 2), {_SLICES}"
_WINDOWS = f"""{_KEPT}, place AS (SELECT read_id, unnest(range(0, length(seq) - {SLICE_K} + 1)) AS pos, seq FROM slices WHERE length(seq) >= {SLICE_K}),
w AS (SELECT read_id, pos, CASE WHEN regexp_matches(f, '[^ACGT]') THEN NULL ELSE {_sql_lesser("f")} END AS kmer FROM (SELECT read_id, pos, substr(seq, pos + 1, {SLICE_K}) AS f FROM place)),
seen AS (SELECT read_id, pos, coalesce(cnt, 0) AS cnt FROM w LEFT JOIN kept USING (kmer)),
per AS (SELECT read_id, count_if(cnt > 0) AS valid, min(CASE WHEN cnt < 3 THEN pos END) AS bad FROM seen GROUP BY read_id),
met AS (SELECT s.read_id, s.seq, coalesce(valid, 0) AS valid, bad, greatest(length(seq) - {SLICE_K} + 1, 0) AS windows FROM slices s LEFT JOIN per USING (read_id))"""


def _sql_number(x: str) -> str:
    return " + ".join(f"CAST(substr(translate({x}, 'ACGT', '0123'), {i + 1}, 1) AS BIGINT) * {4 ** (P - 1 - i)}" for i in range(P))


def _sql_norm(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{K.NOT_ALLOWED}') THEN {4**P} ELSE {_sql_number(x)} END"


_SIGNATURES = f"""{_READS}, {_SLICES}, p0 AS (SELECT read_id, pos, substr(seq, pos + 1, {P}) AS x FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {P} + 1)) AS pos FROM slices WHERE length(seq) >= {P})),
p1 AS (SELECT read_id, pos, x, {_RC.format("x")} AS r, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS run FROM p0 WHERE NOT regexp_matches(x, '[^ACGT]')),
p2 AS (SELECT read_id, run, pos, least({_sql_norm("x")}, {_sql_norm("r")}) AS norm FROM p1),
p3 AS (SELECT read_id, run, pos, min(norm) OVER w AS signature, count(*) OVER w AS n FROM p2 WINDOW w AS (PARTITION BY read_id, run ORDER BY pos ROWS BETWEEN CURRENT ROW AND {LONG_K - P} FOLLOWING)),
sig AS (SELECT read_id, run, pos, signature FROM p3 WHERE n = {LONG_K - P + 1})"""
_SUPER = f"""{_SIGNATURES}, s1 AS (SELECT *, CASE WHEN signature = lag(signature) OVER (PARTITION BY read_id, run ORDER BY pos) THEN 0 ELSE 1 END AS new FROM sig),
s2 AS (SELECT *, sum(new) OVER (PARTITION BY read_id, run ORDER BY pos) AS island FROM s1),
super AS (SELECT read_id, CAST(min(pos) AS INTEGER) AS start, CAST(count(*) + {LONG_K - 1} AS INTEGER) AS len, any_value(signature) AS signature FROM s2 GROUP BY read_id, run, island)"""


#: Whole texts where the other queries have slices.
_UNCUT = "slices AS (SELECT read_id, seq FROM reads WHERE length(seq) > 0)"
_CUT_SUPER = _SUPER.replace("super AS (SELECT", f"s4 AS (SELECT *, (row_number() OVER (PARTITION BY read_id, run, island ORDER BY pos) - 1) // {segments.MOST_WINDOWS} AS part FROM s2),\nsuper AS (SELECT").replace("FROM s2 GROUP BY read_id, run, island", "FROM s4 GROUP BY read_id, run, island, part")


def _folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares files, deleted when the driver ends; only on one machine, where nothing is shared, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(root or 'file:///tmp/checkpoints').rstrip('/')}/braidwork/catalog-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return path


_written: list[tuple[SparkSession, str]] = []


def _drop_all() -> None:
    for spark, path in _written:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def _plain(spark: SparkSession, d: str) -> DataFrame:
    """Reads as the text formats can hold them: line ends and the signs that begin records become full stops."""
    return _weighted(spark, d).withColumn("seq", F.regexp_replace("seq", r"[\s>@+]", "."))


def _written_reads(spark: SparkSession, d: str, kind: str, **options: str) -> str:
    path = _folder(spark)
    writers.write_reads(_plain(spark, d), path, kind, **options)
    return path


def _listed(spark: SparkSession, d: str) -> str:
    """A list of the files of reads, itself a file."""
    reads, path = _written_reads(spark, d, "fasta"), _folder(spark)
    names = spark.read.text(reads).select(F.col("_metadata.file_path").alias("value")).distinct()
    names.coalesce(1).write.text(path)  # a row a file
    return spark.read.text(path).inputFiles()[0]


#: Files that a stream's reads lie in at least, and bytes of text of a file, about.
STREAM_FILES, STREAM_BYTES = 8, 128 << 20


def _stream_files(spark: SparkSession, d: str) -> str:
    """Reads in files of some size: their number, and that of a stream's batches, is not that of the tasks which wrote them."""
    texts = spark.read.parquet(f"{d}/documents.parquet").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    path = _folder(spark)
    writers.write_reads(_plain(spark, d).select("read_id", "header", "seq").repartition(max(STREAM_FILES, -(-texts // STREAM_BYTES)), "read_id"), path, "fasta")
    return path


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """K-mers of reads in files, each sent out once by a stream that goes over them some files at a time."""
    reads, out, state = _stream_files(spark, d), _folder(spark), _folder(spark)
    lines = streamed_lines(spark, reads, files=4)
    write_frequent(frequent_stream(lines, 7), out, state).awaitTermination()
    return spark.read.schema("kmer string, cnt long").parquet(out).select("kmer")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Counts as a stream keeps them, which writes what each batch has changed."""
    reads, out, state = _stream_files(spark, d), _folder(spark), _folder(spark)
    write_changes(count_stream(streamed_lines(spark, reads, files=4), 7), out, state, ci=1).awaitTermination()
    return latest(spark, out)


def _stored_pair(spark: SparkSession, d: str) -> tuple[KmerSet, KmerSet]:
    made = []
    for kmers in _both(spark, d):
        path = _folder(spark)
        kmers.write(path, 8)
        made.append(KmerSet.read(spark, path))
    return made[0], made[1]


def _by_sql(spark: SparkSession, d: str) -> DataFrame:
    """A set as a view, and the functions that SQL has of this package."""
    K.register(spark)
    name = f"kmers_{uuid.uuid4().hex}"
    _set(spark, d, None).create_view(name)
    return spark.sql(f"SELECT kmer, revcomp(kmer) AS rc, canonical_kmer(revcomp(kmer)) AS own, packed_kmer(kmer) AS packed FROM {name} WHERE cnt >= 2")


def _written_set(spark: SparkSession, d: str) -> KmerSet:
    path = _folder(spark)
    _set(spark, d, None).write(path, 4)
    return KmerSet.read(spark, path, 2, 100)


_RUN_COLUMNS = "tool string, n int, t long, k int, rep int, user_s double, cpu_pct double, max_rss_kb long"


def _written_runs(spark: SparkSession, d: str) -> DataFrame:
    path, runs = _folder(spark), _runs(spark, d)
    writers.append_csv(runs.where("tool = 'A'"), path)
    writers.append_csv(runs.where("tool <> 'A'"), path)
    return readers.decimal_comma_csv(spark, path, _RUN_COLUMNS)


#: What the time command prints, as far as it matters: a name and a number a line, in this order; the numbers come of a nation's key.
_LOG = [("User time (seconds)", "{k} * 0.25"), ("System time (seconds)", "0.5"), ("Percent of CPU this job got", "concat({k} + 90, '%')"), ("Elapsed (wall clock) time (h:mm:ss or m:ss)", "concat('0:', {k} + 10, '.77')"), ("Average shared text size (kbytes)", "0"), ("Average unshared data size (kbytes)", "0"), ("Average stack size (kbytes)", "0"), ("Average total size (kbytes)", "0"), ("Maximum resident set size (kbytes)", "{k} * 1000 + 4096"), ("Page size (bytes)", "4096")]


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """A log for each nation, written as a file of its own."""
    path, lines = _folder(spark), ", ".join(f"concat('{name}: ', {value.format(k='n_nationkey')})" for name, value in _LOG)
    logs = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey AS of", f"concat_ws('\n', {lines}) AS value")
    logs.write.partitionBy("of").text(path)
    return readers.resource_log(spark, f"{path}/*")


_MODES = "CASE {0} % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'trim' ELSE 'mask' END"


def _modes(spark: SparkSession, d: str) -> DataFrame:
    """Whether the modes and thresholds that documents ask for go together; each combination is checked once."""
    asked = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"{_MODES.format('doc_id')} AS mode", "CAST(IF(doc_id % 2 = 0, 2, 0.25) AS DOUBLE) AS least", "CAST(IF(doc_id % 2 = 0, 10, 0.5) AS DOUBLE) AS most")

    def fits(mode: str, least: float, most: float) -> bool:
        try:
            R.check_mode(mode, *(int(x) if x == int(x) else x for x in (least, most)))
        except ValueError:
            return False
        return True

    rules = [(*r, fits(*r)) for r in asked.select("mode", "least", "most").distinct().collect()]  # six at most
    return asked.join(F.broadcast(spark.createDataFrame(rules, "mode string, least double, most double, fits boolean")), ["mode", "least", "most"]).select("doc_id", "mode", "least", "most", "fits")


def _generated(spark: SparkSession, d: str) -> DataFrame:
    """As many random reads as there are documents."""
    return readers.generated(spark, 80, spark.read.parquet(f"{d}/documents.parquet").count(), 0.4, None, 0.1)


def _defined(spark: SparkSession, d: str) -> DataFrame:
    """A definition file that names two written sets, and what its expression makes of them."""
    root = _folder(spark)
    for name, kmers in zip("ab", _both(spark, d)):
        kmers.write(f"{root}/{name}")
    text = f"INPUT:\na = {root}/a\nb = {root}/b\nOUTPUT:\n{root}/made = a * max b\nOUTPUT_PARAMS:\n-ci2 -cs20\n"
    return parse_definition(text).run(lambda path, **cut: KmerSet.read(spark, path, **cut)).df


def _value(rows: str) -> str:
    return f"({_RUN_SQL.format('lineitem')}) r {rows}"


def _sql_whole(sql: str) -> str:
    """Over all texts, where ``sql`` has the English ones."""
    return sql.replace("WHERE lang = 'en'", "WHERE true")


def catalog() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """Each query with its SQL; a few without, where only Spark can make the rows."""
    q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

    def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
        q[name] = (run, sql)

    count = lambda s, d, k=LONG_K, **o: counting.count_all(_reads(s, d), k, **o)
    # counting
    add("count", lambda s, d: count(s, d), _counted(LONG_K, "SELECT kmer, cnt FROM counts"))
    add("count_forward", lambda s, d: count(s, d, both_strands=False), _counted(LONG_K, "SELECT kmer, cnt FROM counts", both=False))
    add("count_small_k", lambda s, d: count(s, d, 5), _counted(5, "SELECT kmer, cnt FROM counts"))
    add("count_long_k", lambda s, d: count(s, d, 60), _counted(60, "SELECT kmer, cnt FROM counts"))
    add("count_cutoffs", lambda s, d: KmerSet.count(_reads(s, d), SET_K, 2, 1000, 20).df, _counted(SET_K, "SELECT kmer, least(cnt, 20) AS cnt FROM counts WHERE cnt BETWEEN 2 AND 1000"))
    add("count_defaults", lambda s, d: KmerSet.count(_reads(s, d)).df, _counted(25, "SELECT kmer, least(cnt, 255) AS cnt FROM counts WHERE cnt >= 2"))
    add("solid_kmers", lambda s, d: counting.thresholds(count(s, d), 3), _counted(LONG_K, "SELECT kmer, cnt FROM counts WHERE cnt >= 3"))
    add("frequent_counted", lambda s, d: counting.thresholds(count(s, d), 2), _counted(LONG_K, "SELECT kmer, cnt FROM counts WHERE cnt >= 2"))
    add("frequent_only", lambda s, d: counting.thresholds(count(s, d), 2).select("kmer"), _counted(LONG_K, "SELECT kmer FROM counts WHERE cnt >= 2"))
    add("count_brute_force", lambda s, d: count(s, d, SET_K, both_strands=False).where("cnt > 1"), _counted(SET_K, "SELECT kmer, cnt FROM counts WHERE cnt > 1", both=False))
    add("count_order_actg", lambda s, d: count(s, d, SET_K, order="ACTG"), _counted(SET_K, "SELECT kmer, cnt FROM counts", order="ACTG"))
    add("count_order_catg", lambda s, d: count(s, d, SET_K, order="CATG"), _counted(SET_K, "SELECT kmer, cnt FROM counts", order="CATG"))
    weighted_sql = f"""WITH {_READS}, {_SLICES}, place AS (SELECT read_id, seq, unnest(range(0, length(seq) - {SET_K} + 1)) AS pos FROM slices WHERE length(seq) >= {SET_K}),
    k0 AS (SELECT substr(seq, pos + 1, {SET_K}) AS f, list_reduce([greatest(0.25, 1 - pow(10, -((read_id * 31 + i * 7) % 41) / 10.0)) FOR i IN range(pos + 1, pos + {SET_K + 1})], lambda a, x: a * x) AS w FROM place)
    SELECT {_sql_lesser("f")} AS kmer, round(sum(w), 6) AS cnt FROM k0 WHERE NOT regexp_matches(f, '[^ACGT]') GROUP BY 1"""
    add("count_weighted", lambda s, d: counting.count_weighted(_weighted(s, d), SET_K).select("kmer", F.round("cnt", 6).alias("cnt")), weighted_sql)
    add("count_by_signature", lambda s, d: segments.count_by_signature(_slices(s, d), LONG_K, P), f"WITH {_READS}, {_SLICES}, {_sql_counts(LONG_K).replace('FROM reads', 'FROM slices')} SELECT kmer, cnt FROM counts")
    add("statistics", lambda s, d: counting.statistics(count(s, d), _reads(s, d), 2, 50), _counted(LONG_K, "SELECT count_if(cnt < 2)::BIGINT AS n_below_min, count_if(cnt > 50)::BIGINT AS n_above_max, count(*) AS n_unique, count_if(cnt BETWEEN 2 AND 50)::BIGINT AS n_unique_counted, coalesce(sum(cnt), 0)::BIGINT AS n_total, (SELECT count(*) FROM reads) AS n_reads FROM counts"))
    summary_sql = _counted(LONG_K, "SELECT '{\"n_below_min\":' || count_if(cnt < 2) || ',\"n_above_max\":' || count_if(cnt > 50) || ',\"n_unique\":' || count(*) || ',\"n_unique_counted\":' || count_if(cnt BETWEEN 2 AND 50) || ',\"n_total\":' || coalesce(sum(cnt), 0) || ',\"n_reads\":' || (SELECT count(*) FROM reads) || '}' AS value FROM counts")
    add("summary_json", lambda s, d: writers.summary_json(counting.statistics(count(s, d), _reads(s, d), 2, 50)), summary_sql)
    # one set
    en = lambda s, d, **o: _set(s, d, True, **o)
    one = lambda select: f"WITH {_SETS} {select}"

    def of_one_set(prefix: str, en: Callable[..., KmerSet], one: Callable[[str], str]) -> None:
        add(prefix + "histogram", lambda s, d: en(s, d).histogram(), one("SELECT cnt, count(*) AS n_kmers FROM a GROUP BY cnt"))
        add(prefix + "histogram_dense", lambda s, d: en(s, d).histogram(1, 255, dense=True), one("SELECT r.cnt, count(a.kmer) AS n_kmers FROM range(1, 256) r(cnt) LEFT JOIN a USING (cnt) GROUP BY r.cnt"))
        add(prefix + "reduce", lambda s, d: en(s, d).reduce(2, 100, 10).df, one("SELECT kmer, least(cnt, 10) AS cnt FROM a WHERE cnt BETWEEN 2 AND 100"))
        add(prefix + "compact", lambda s, d: en(s, d).compact(2).df, one("SELECT kmer, CAST(1 AS BIGINT) AS cnt FROM a WHERE cnt >= 2"))
        add(prefix + "sort", lambda s, d: en(s, d).sort().df, one("SELECT kmer, cnt FROM a ORDER BY kmer"))
        add(prefix + "with_cutoffs", lambda s, d: en(s, d).with_cutoffs(3, 9).df, one("SELECT kmer, cnt FROM a WHERE cnt BETWEEN 3 AND 9"))
        add(prefix + "set_size", lambda s, d: en(s, d).with_cutoffs(2, 9).df.agg(F.count("*").alias("n_kmers")), one("SELECT count(*) AS n_kmers FROM a WHERE cnt BETWEEN 2 AND 9"))
        add(prefix + "info", lambda s, d: en(s, d).info(), one(f"SELECT {SET_K}::BIGINT AS k, 0::BIGINT AS mode, 1::BIGINT AS counter_size, 1::BIGINT AS min_count, 1000000000::BIGINT AS max_count, count(*) AS total_kmers, true AS both_strands FROM a"))
        add(prefix + "check", lambda s, d: en(s, d).lookup(["AAAAAAAAAAA", "acgtacgtacg", "CCCCCCCCCCC", "TTTTTTTTTTT"]), one("SELECT x.kmer, coalesce(a.cnt, 0) AS cnt FROM (VALUES ('AAAAAAAAAAA'), ('ACGTACGTACG'), ('CCCCCCCCCCC'), ('TTTTTTTTTTT')) x(kmer) LEFT JOIN a USING (kmer)"))
        add(prefix + "dump", lambda s, d: writers.dump_lines(en(s, d).df, 2, 50), one("SELECT kmer || chr(9) || cnt AS value FROM a WHERE cnt BETWEEN 2 AND 50"))
        add(prefix + "dump_sorted", lambda s, d: writers.dump_lines(en(s, d).df, in_order=True), one("SELECT kmer || chr(9) || cnt AS value FROM a ORDER BY kmer"))
        add(prefix + "dump_blank", lambda s, d: writers.dump_lines(en(s, d).df, separator=" "), one("SELECT kmer || ' ' || cnt AS value FROM a"))
        add(prefix + "dump_fasta", lambda s, d: writers.fasta_count_lines(en(s, d).df), one("SELECT '>' || cnt || chr(10) || kmer AS value FROM a"))
        add(prefix + "dump_weighted", lambda s, d: writers.dump_lines(en(s, d).df.withColumn("cnt", F.col("cnt") / 4), 0, weighted=True), one("SELECT kmer || chr(9) || printf('%.6f', cnt / 4.0) AS value FROM a"))
        add(prefix + "histogram_lines", lambda s, d: writers.histogram_lines(en(s, d).histogram()), one("SELECT cnt || chr(9) || count(*) AS value FROM a GROUP BY cnt"))
        add(prefix + "kmer_functions", lambda s, d: en(s, d).df.select("kmer", K.reverse_complement("kmer").alias("rc"), K.packed("kmer").alias("packed"), K.symbol("kmer", 3).alias("symbol"), K.symbol_code("kmer", 3).cast("int").alias("code"), K.canonical("kmer", "CATG").alias("other_order")), one("SELECT kmer, " + _RC.format("kmer") + " AS rc, " + " + ".join(f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1)::BIGINT * {4 ** (SET_K - 1 - i)}" for i in range(SET_K)) + " AS packed, substr(kmer, 4, 1) AS symbol, CAST(instr('ACGT', substr(kmer, 4, 1)) - 1 AS INTEGER) AS code, " + _sql_lesser("kmer", "CATG") + " AS other_order FROM a"))

    of_one_set("", en, one)
    of_one_set("whole_", lambda s, d, **o: _set(s, d, None, **o), lambda select: _sql_whole(one(select)))
    # two sets
    for rule in COUNTER_RULES:
        add(f"intersect_{rule}", lambda s, d, r=rule: (p := _both(s, d))[0].intersect(p[1], r).df, one(_sql_pair("inner", _RULE[rule])))
        add(f"union_{rule}", lambda s, d, r=rule: (p := _both(s, d))[0].union(p[1], r).df, one(_sql_union(rule)))
        add(f"counters_subtract_{rule}", lambda s, d, r=rule: (p := _both(s, d))[0].counters_subtract(p[1], r).df, one(_sql_left(rule)))
    anti = "SELECT {0}.kmer, {0}.cnt FROM {0} WHERE NOT EXISTS (SELECT 1 FROM {1} WHERE {1}.kmer = {0}.kmer)"
    add("kmers_subtract", lambda s, d: (p := _both(s, d))[0].kmers_subtract(p[1]).df, one(anti.format("a", "b")))
    add("reverse_kmers_subtract", lambda s, d: (p := _both(s, d))[0].reverse_kmers_subtract(p[1]).df, one(anti.format("b", "a")))
    add("reverse_counters_subtract", lambda s, d: (p := _both(s, d))[0].reverse_counters_subtract(p[1]).df, one(_sql_pair("left", "CASE WHEN b.kmer IS NULL THEN a.cnt ELSE a.cnt - b.cnt END", "b", "a")))
    add("compare", lambda s, d: (p := _both(s, d))[0].differences(p[1]).agg((F.count("*") == 0).alias("same"), F.count("*").alias("n_different")), one("SELECT count(*) = 0 AS same, count(*) AS n_different FROM a FULL JOIN b ON a.kmer = b.kmer WHERE a.cnt IS DISTINCT FROM b.cnt"))
    outputs = {"both": Output("intersect", "max", ci=2), "either": Output("union", cs=9), "own": Output("kmers_subtract"), "less": Output("counters_subtract"), "other": Output("reverse_kmers_subtract", cx=3)}
    simple_sql = " UNION ALL ".join([
        "SELECT 'both' AS output, a.kmer, least(greatest(a.cnt, b.cnt), 255) AS cnt FROM a JOIN b USING (kmer) WHERE greatest(a.cnt, b.cnt) >= 2",
        "SELECT 'either', coalesce(a.kmer, b.kmer), least(coalesce(a.cnt, 0) + coalesce(b.cnt, 0), 9) FROM a FULL JOIN b ON a.kmer = b.kmer",
        "SELECT 'own', a.kmer, a.cnt FROM a LEFT JOIN b USING (kmer) WHERE b.cnt IS NULL",
        "SELECT 'less', a.kmer, a.cnt - coalesce(b.cnt, 0) FROM a LEFT JOIN b USING (kmer) WHERE a.cnt > coalesce(b.cnt, 0)",
        "SELECT 'other', b.kmer, b.cnt FROM b LEFT JOIN a USING (kmer) WHERE a.cnt IS NULL AND b.cnt <= 3",
    ])
    few = lambda s, d: (_set(s, d, True, 7), _set(s, d, False, 7))  # noqa: E731  of fewer k-mers, as all outputs together are many rows
    add("simple_outputs", lambda s, d: simple(*few(s, d), outputs), f"WITH {_sets_sql(7)} {simple_sql}")
    expression_sql = "SELECT u.kmer, least(CASE WHEN b.cnt IS NULL THEN u.cnt ELSE u.cnt - b.cnt END, 255) AS cnt FROM (SELECT kmer, least(sum(cnt), 255)::BIGINT AS cnt FROM (SELECT * FROM a UNION ALL SELECT a.kmer, b.cnt FROM a JOIN b USING (kmer)) GROUP BY kmer) u LEFT JOIN b USING (kmer) WHERE b.cnt IS NULL OR u.cnt > b.cnt"
    add("expression", lambda s, d: (p := _both(s, d)) and evaluate("(a + sum a * right b) ~ b", {"a": p[0], "b": p[1]}).df, one(expression_sql))
    # reads
    kept = lambda s, d: _set(s, d, True, SLICE_K, 2)
    windows = lambda select: f"WITH {_WINDOWS} {select}"

    def of_reads(prefix: str, kept: Callable[[SparkSession, str], KmerSet], windows: Callable[[str], str]) -> None:
        add(prefix + "read_counters", lambda s, d: R.counters(_slices(s, d), kept(s, d)).select("read_id", F.array_join(F.col("counters").cast("array<string>"), ",").alias("counters")), windows("SELECT s.read_id, coalesce(string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY pos), '') AS counters FROM slices s LEFT JOIN seen USING (read_id) GROUP BY s.read_id"))
        add(prefix + "valid_windows", lambda s, d: R.valid_windows(_slices(s, d), kept(s, d)), windows("SELECT read_id, CAST(valid AS BIGINT) AS n_valid FROM met"))
        add(prefix + "filter_reads", lambda s, d: R.filter_reads(_slices(s, d), kept(s, d), 10, 80).select("read_id", "seq"), windows("SELECT read_id, seq FROM met WHERE valid BETWEEN 10 AND 80"))
        add(prefix + "filter_reads_fraction", lambda s, d: R.filter_reads(_slices(s, d), kept(s, d), 0.25, 0.75).select("read_id", "seq"), windows("SELECT read_id, seq FROM met WHERE valid >= floor(windows * 0.25::DOUBLE) AND valid <= floor(windows * 0.75::DOUBLE)"))
        add(prefix + "trim_reads", lambda s, d: R.trim_reads(_slices(s, d), kept(s, d), 3).select("read_id", "seq"), windows(f"SELECT read_id, CASE WHEN bad IS NULL THEN seq ELSE substr(seq, 1, CAST(bad AS BIGINT) + {SLICE_K - 1}) END AS seq FROM met WHERE windows > 0 AND (bad IS NULL OR bad > 0)"))
        mask_sql = f""", base AS (SELECT s.read_id, i, substr(seq, CAST(i AS BIGINT) + 1, 1) AS c FROM (SELECT read_id, seq, unnest(range(0, length(seq))) AS i FROM slices) s),
    masked AS (SELECT b.read_id, i, CASE WHEN max(CASE WHEN cnt < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY b.read_id ORDER BY i ROWS BETWEEN {SLICE_K - 1} PRECEDING AND CURRENT ROW) = 1 THEN 'N' ELSE c END AS c FROM base b LEFT JOIN seen s ON b.read_id = s.read_id AND b.i = s.pos)
    SELECT read_id, string_agg(c, '' ORDER BY i) AS seq FROM masked GROUP BY read_id"""
        add(prefix + "mask_reads", lambda s, d: R.mask_reads(_slices(s, d), kept(s, d), 3).select("read_id", "seq"), windows(mask_sql))

    of_reads("", kept, windows)
    of_reads("whole_", lambda s, d: _set(s, d, None, SLICE_K, 2), lambda select: _sql_whole(windows(select)))
    add("fasta_lines", lambda s, d: writers.read_lines(_slices(s, d), "fasta"), f"WITH {_READS}, {_SLICES} SELECT '>' || read_id || chr(10) || seq AS value FROM slices")
    # signatures
    add("signatures", lambda s, d: segments.read_signatures(_slices(s, d), LONG_K, P).select("read_id", "pos", "signature"), f"WITH {_SIGNATURES} SELECT read_id, CAST(pos AS INTEGER) AS pos, signature FROM sig")
    add("super_kmers", lambda s, d: segments.super_kmers(_slices(s, d), LONG_K, P), f"WITH {_SUPER} SELECT read_id, start, len, signature FROM super")
    add("signature_statistics", lambda s, d: segments.signature_statistics(_slices(s, d), LONG_K, P), f"WITH {_SIGNATURES} SELECT signature, count(*) AS n_kmers FROM sig GROUP BY signature")
    # over whole texts
    uncut = lambda name: q[name][1].replace(_SLICES, _UNCUT)
    add("uncut_count_weighted", lambda s, d: counting.count_weighted(_weighted(s, d, True), SET_K).select("kmer", F.round("cnt", 6).alias("cnt")), uncut("count_weighted"))
    add("uncut_count_by_signature", lambda s, d: segments.count_by_signature(_reads(s, d), LONG_K, P), _counted(LONG_K, "SELECT kmer, cnt FROM counts"))
    add("uncut_signatures", lambda s, d: segments.read_signatures(_reads(s, d), LONG_K, P).select("read_id", "pos", "signature"), uncut("signatures"))
    add("uncut_super_kmers", lambda s, d: segments.super_kmers(_reads(s, d), LONG_K, P), f"WITH {_CUT_SUPER} SELECT read_id, start, len, signature FROM super".replace(_SLICES, _UNCUT))
    add("uncut_signature_statistics", lambda s, d: segments.signature_statistics(_reads(s, d), LONG_K, P), uncut("signature_statistics"))
    # functions
    add("base_probability", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.round(K.base_probability(F.char(F.col("doc_id") % 42 + 33)), 12).alias("p")), "SELECT doc_id, round(greatest(0.25, 1 - pow(10, -(doc_id % 42) / 10.0)), 12) AS p FROM documents")
    # benchmark
    add("benchmark_averages", lambda s, d: readers.averages(_runs(s, d)), "SELECT tool, n, t::BIGINT AS t, k, count(*) AS n_runs, avg(user_s)::DOUBLE AS avg_user_s, min(user_s)::DOUBLE AS min_user_s, max(user_s)::DOUBLE AS max_user_s, avg(cpu_pct)::DOUBLE AS avg_cpu_pct, min(cpu_pct)::DOUBLE AS min_cpu_pct, max(cpu_pct)::DOUBLE AS max_cpu_pct, avg(max_rss_kb)::DOUBLE AS avg_max_rss_kb, min(max_rss_kb)::BIGINT AS min_max_rss_kb, max(max_rss_kb)::BIGINT AS max_max_rss_kb FROM " + _value("GROUP BY tool, n, t, k"))
    add("benchmark_side_by_side", lambda s, d: readers.side_by_side(_runs(s, d).where("tool = 'N'").groupBy("n", "t", "k", "rep").agg(F.max("user_s").alias("user_s"))), "SELECT n, t::BIGINT AS t, k, max(CASE WHEN rep = 1 THEN user_s END)::DOUBLE AS user_s_1, max(CASE WHEN rep = 2 THEN user_s END)::DOUBLE AS user_s_2, max(CASE WHEN rep = 3 THEN user_s END)::DOUBLE AS user_s_3 FROM " + _value("WHERE tool = 'N' GROUP BY n, t, k"))
    add("generated_reads", lambda s, d: _generated(s, d).select("read_id", F.length("seq").cast("long").alias("n"), F.length(F.translate("seq", "ACGT", "")).cast("long").alias("not_symbols")), "SELECT row_number() OVER () - 1 AS read_id, 80::BIGINT AS n, 0::BIGINT AS not_symbols FROM documents")
    # files, written and read again
    plain = f"{_READS}, {_SLICES}, plain AS (SELECT CAST(read_id AS VARCHAR) AS header, regexp_replace(seq, '[\\s>@+]', '.', 'g') AS seq, list_reduce(list_transform(range(1, length(seq) + 1), lambda i: chr(CAST(33 + (read_id * 31 + i * 7) % 41 AS INTEGER))), lambda x, y: x || y) AS qual FROM slices)"
    add("fasta_file", lambda s, d: readers.fasta(s, _written_reads(s, d, "fasta")).select("header", "seq"), f"WITH {plain} SELECT header, seq FROM plain")
    add("fasta_file_one_line", lambda s, d: readers.fasta(s, _written_reads(s, d, "fasta"), multiline=False).select("header", "seq"), f"WITH {plain} SELECT header, seq FROM plain")
    add("fastq_file", lambda s, d: readers.fastq(s, _written_reads(s, d, "fastq")).select("header", "seq", "qual"), f"WITH {plain} SELECT header, seq, qual FROM plain")
    add("fastq_file_split", lambda s, d: readers.fastq(s, _written_reads(s, d, "fastq"), multiline=False).select("header", "seq", "qual"), f"WITH {plain} SELECT header, seq, qual FROM plain")
    add("line_file", lambda s, d: readers.line_reads(s, _written_reads(s, d, "fasta")).select("seq"), f"WITH {plain} SELECT seq FROM plain")
    for codec in ("gzip", "bzip2"):
        add(f"fasta_file_{codec}", lambda s, d, c=codec: readers.fasta(s, _written_reads(s, d, "fasta", compression=c)).select("header", "seq"), f"WITH {plain} SELECT header, seq FROM plain")
    add("fasta_file_list", lambda s, d: readers.fasta(s, _listed(s, d)).select("header", "seq"), f"WITH {plain} SELECT header, seq FROM plain")
    add("fastq_file_whole", lambda s, d: readers.fastq(s, _written_reads(s, d, "fastq"), multiline=True).select("header", "seq", "qual"), f"WITH {plain} SELECT header, seq, qual FROM plain")
    of_plain = lambda select: f"WITH {plain}, {_sql_counts(7).replace('FROM reads', 'FROM plain')} {select}"
    add("streamed_frequent", _streamed, of_plain("SELECT kmer FROM counts WHERE cnt >= 2"))
    add("streamed_changes", _changes, of_plain("SELECT kmer, cnt FROM counts"))
    add("sql_functions", _by_sql, _sql_whole(one(f"SELECT kmer, {_RC.format('kmer')} AS rc, kmer AS own, " + " + ".join(f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1)::BIGINT * {4 ** (SET_K - 1 - i)}" for i in range(SET_K)) + " AS packed FROM a WHERE cnt >= 2")))
    add("stored_intersect", lambda s, d: (p := _stored_pair(s, d))[0].intersect(p[1], "sum").df, one(_sql_pair("inner", _RULE["sum"])))
    add("written_set", lambda s, d: _written_set(s, d).df, _sql_whole(one("SELECT kmer, cnt FROM a WHERE cnt BETWEEN 2 AND 100")))
    add("definition_file", _defined, one("SELECT a.kmer, least(greatest(a.cnt, b.cnt), 20) AS cnt FROM a JOIN b USING (kmer) WHERE greatest(a.cnt, b.cnt) >= 2"))
    add("resource_log", lambda s, d: _logs(s, d).select("user_s", "cpu_pct", "wall", "max_rss_kb"), "SELECT n_nationkey * 0.25::DOUBLE AS user_s, (n_nationkey + 90)::DOUBLE AS cpu_pct, '0:' || (n_nationkey + 10) || '.77' AS wall, (n_nationkey * 1000 + 4096)::BIGINT AS max_rss_kb FROM nation")
    add("decimal_comma_csv", lambda s, d: _written_runs(s, d), "SELECT tool, n, t::BIGINT AS t, k, rep, user_s::DOUBLE AS user_s, cpu_pct::DOUBLE AS cpu_pct, max_rss_kb::BIGINT AS max_rss_kb FROM " + _value(""))
    add("numbered_fasta", lambda s, d: writers.fasta_count_lines(en(s, d).df, numbered=True), one("SELECT '>' || row_number() OVER (ORDER BY kmer) || chr(10) || kmer AS value FROM a"))
    # small things
    add("packed_words", lambda s, d: count(s, d, 60).select("kmer", K.unpacked(K.packed_words("kmer", 60), 60).alias("back"), F.get(K.packed_words("kmer", 60), F.lit(1)).alias("second")), _counted(60, "SELECT kmer, kmer AS back, " + " + ".join(f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1)::BIGINT * {4 ** (59 - i)}" for i in range(31, 60)) + " AS second FROM counts"))
    asked = lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.substring(F.regexp_replace(F.translate(F.lower("text"), readers.LETTERS, readers.SYMBOLS), "[^ACGT]", ""), 1, SET_K).alias("kmer"))
    add("contains", lambda s, d: _set(s, d, None).lookup_all(asked(s, d)).select("doc_id", "kmer", "cnt", (F.col("cnt") > 0).alias("held")), _sql_whole(one(f"SELECT x.doc_id, x.kmer, coalesce(a.cnt, 0) AS cnt, a.kmer IS NOT NULL AS held FROM (SELECT read_id AS doc_id, substr(regexp_replace(seq, '[^ACGT]', '', 'g'), 1, {SET_K}) AS kmer FROM reads) x LEFT JOIN a USING (kmer)")))
    add("mode_check", _modes, f"SELECT doc_id, mode, least, most, mode = 'normal' OR least >= 1 AS fits FROM (SELECT doc_id, {_MODES.format('doc_id')} AS mode, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0.25 END::DOUBLE AS least, CASE WHEN doc_id % 2 = 0 THEN 10 ELSE 0.5 END::DOUBLE AS most FROM documents)")
    norms = "list_min([" + ", ".join(f"least({_sql_norm(x)}, {_sql_norm(_RC.format(x))})" for x in (f"substr(kmer, {i + 1}, {P})" for i in range(SET_K - P + 1))) + "])"
    add("kmer_signature", lambda s, d: en(s, d).df.select("kmer", K.signature("kmer", P).alias("signature")), one(f"SELECT kmer, CAST({norms} AS BIGINT) AS signature FROM a"))
    add("whole_kmer_signature", lambda s, d: _set(s, d, None).df.select("kmer", K.signature("kmer", P).alias("signature")), _sql_whole(q["kmer_signature"][1]))
    add("whole_numbered_fasta", lambda s, d: writers.fasta_count_lines(_set(s, d, None).df, numbered=True), _sql_whole(q["numbered_fasta"][1]))
    add("uncut_statistics_super_kmers", lambda s, d: segments.run_statistics(_reads(s, d), LONG_K, P, 2, 50, sample=_few(s, d)), f"WITH {_CUT_SUPER}, {_sql_counts(LONG_K)} SELECT count_if(cnt < 2)::BIGINT AS n_below_min, count_if(cnt > 50)::BIGINT AS n_above_max, count(*) AS n_unique, count_if(cnt BETWEEN 2 AND 50)::BIGINT AS n_unique_counted, coalesce(sum(cnt), 0)::BIGINT AS n_total, (SELECT count(*) FROM reads) AS n_reads, (SELECT count(*) FROM super) AS n_super_kmers FROM counts".replace(_SLICES, _UNCUT))
    add("statistics_super_kmers", lambda s, d: segments.run_statistics(_slices(s, d), LONG_K, P, 2, 50, sample=readers.slices(_few(s, d), 100)), f"WITH {_CUT_SUPER}, {_sql_counts(LONG_K).replace('FROM reads', 'FROM slices')} SELECT count_if(cnt < 2)::BIGINT AS n_below_min, count_if(cnt > 50)::BIGINT AS n_above_max, count(*) AS n_unique, count_if(cnt BETWEEN 2 AND 50)::BIGINT AS n_unique_counted, coalesce(sum(cnt), 0)::BIGINT AS n_total, (SELECT count(*) FROM slices) AS n_reads, (SELECT count(*) FROM super) AS n_super_kmers FROM counts")
    return q
