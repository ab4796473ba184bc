"""Removal of repeated passages of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Lines of a window.
WINDOW = 3


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with repeated lines gone from ``text``, and ``n_lines`` and ``n_removed`` (both long).

    Lines are what newlines separate. Each run of three consecutive lines of a text is a window,
    named by two 64-bit hashes. All windows that are equal anywhere count as occurrences of one;
    the one with the least (doc_id, hash of the text, position) stays and each line that a later one
    covers goes. Windows are judged on the input, not on what is left.

    Built-in functions only. The names and their first occurrences are aggregated map-side; the
    windows meet them in a join of two plain exchanges, which the runtime splits where one window
    is very common. A null text stays null with no lines; a text of fewer than three lines, the
    empty one included, has no window and stays. A null doc_id comes before all others. Rows equal
    in doc_id and text are one document. Other columns pass through; ones named n_lines or
    n_removed are replaced. Empty input: no rows.
    """
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    body, lines = F.col(f"`{text}`"), F.split(F.col(f"`{text}`"), "\n", -1)
    doc = F.struct(F.col(f"`{key}`").isNotNull().alias("known"), F.col(f"`{key}`").alias("id"), F.xxhash64(body).alias("h"))
    rows = df.select(doc.alias("doc"), lines.alias("line")).where(F.size("line") >= WINDOW)
    at = F.col("at")
    names3 = F.expr(f"transform(sequence(0, size(line) - {WINDOW}), i -> struct(i AS at, xxhash64(line[i], line[i + 1], line[i + 2]) AS h1, xxhash64(line[i + 2], line[i], line[i + 1], 3) AS h2))")
    windows = materialize(rows.select("doc", F.inline(names3)).select(F.col("doc.known").alias("known"), F.col("doc.id").alias("id"), F.col("doc.h").alias("h"), at, "h1", "h2"), "line-windows")
    firsts = windows.groupBy("h1", "h2").agg(F.min(F.struct("known", "id", "h", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = materialize(firsts, "line-firsts")
    later = windows.join(firsts, ["h1", "h2"]).where(F.expr("NOT (struct(known, id, h, at) <=> first)"))
    starts = later.groupBy("known", "id", "h").agg(F.sort_array(F.collect_set("at")).alias("p"))
    # maximal covered runs [from, to), and the runs of lines between them
    runs = starts.select("known", "id", "h", F.expr(f"filter(p, (x, i) -> i = 0 OR p[i - 1] + {WINDOW} < x)").alias("lo"), F.expr(f"transform(filter(p, (x, i) -> i = size(p) - 1 OR p[i + 1] > x + {WINDOW}), x -> x + {WINDOW})").alias("hi"))
    docs = df.select(*[F.col(f"`{c}`") for c in names], doc.alias("_bw_doc"))
    runs = runs.select(F.col("known").alias("_bw_k"), F.col("id").alias("_bw_i"), F.col("h").alias("_bw_h"), F.col("lo").alias("_bw_lo"), F.col("hi").alias("_bw_hi"))
    same = (F.col("_bw_doc.known") == F.col("_bw_k")) & F.col("_bw_doc.id").eqNullSafe(F.col("_bw_i")) & (F.col("_bw_doc.h") == F.col("_bw_h"))
    met = docs.join(runs, same, "left")
    split = F.expr(f"split(`{text}`, '\\n', -1)")
    kept = F.expr("flatten(transform(sequence(0, size(_bw_lo)), i -> slice(_bw_line, IF(i = 0, 0, _bw_hi[i - 1]) + 1, IF(i = size(_bw_lo), size(_bw_line), _bw_lo[i]) - IF(i = 0, 0, _bw_hi[i - 1]))))")
    met = met.withColumn("_bw_line", split)
    left = F.when(F.col("_bw_lo").isNull(), body).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("_bw_lo").isNull(), F.lit(0)).otherwise(F.expr("aggregate(zip_with(_bw_lo, _bw_hi, (a, b) -> b - a), 0, (s, x) -> s + x)"))
    out = [left.alias(c) if c == text else F.col(f"`{c}`") for c in names]
    n = F.when(body.isNull(), F.lit(0)).otherwise(F.size("_bw_line"))
    return met.select(*out, n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def digest(documents: DataFrame) -> DataFrame:
    """Per document: its lines, those removed, and a checksum of the text that stays."""
    out = line_dedup(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


#: Rows with several equal documents of one id are not told apart here; the tables have none.
SQL = """
WITH line AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), three AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM three WHERE c IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, range(3) r(k) WHERE n > 1
), left_over AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN left_over USING (doc_id)
"""
