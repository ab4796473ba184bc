"""Mixing sources to target weights over a tree of domains, languages and sources."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_total

LEVELS = ("domain", "lang", "source")
#: Weights by path in the tree; what is not named weighs 1 among its siblings.
WEIGHTS: dict[tuple[str, ...], int] = {("web",): 2, ("web", "en"): 3, ("books", "en"): 2, ("forum", "en"): 2, ("web", "en", "src0"): 4, ("web", "de", "src0"): 2}
#: Tokens to select, as a share of all there are, and how often a document may be used.
BUDGET_SHARE, MAX_EPOCHS = 0.8, 2
ROWS_PER_BUCKET = 1024


def domain_of(source: str) -> Column:
    """The tables name no domain; sources are grouped by the remainder of their number by 3."""
    n = F.regexp_extract(F.col(source), r"^src([0-9]+)$", 1)
    return F.when(F.coalesce(n, F.lit("")) == "", "other").otherwise(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forum")), (F.expr("try_cast(regexp_extract(%s, '^src([0-9]+)$', 1) AS int)" % source) % 3 + 1).cast("int")))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: dict[tuple[str, ...], float], budget: Column, epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with the ``allowance`` of each, in whole tokens.

    A node may take ``epochs`` times its tokens. From the root down, siblings share what their parent
    gets by weight; what one cannot take goes to its siblings by their weights, and only what none of
    them can take lowers the parent's share, to the good of the parent's own siblings.
    """
    spark = leaves.sparkSession
    names = list(levels)
    tree = leaves.withColumn("cap_%d" % len(names), F.col("tokens") * epochs)
    nodes: list[DataFrame] = []
    for depth in range(len(names), 0, -1):  # what each node can take, from the leaves up
        if depth < len(names):
            tree = nodes[-1].groupBy(*names[:depth]).agg(F.sum("cap").alias("cap_%d" % depth))
        here = [(*path, float(w)) for path, w in weights.items() if len(path) == depth]
        schema = ", ".join(f"w{i} string" for i in range(depth)) + ", w double"
        told = spark.createDataFrame(here, schema)  # as large as the weights given
        same = F.lit(True)
        for i in range(depth):
            same = same & (F.col(names[i]) == F.col(f"w{i}"))
        weighed = tree.join(F.broadcast(told), same, "left").withColumn("weight", F.greatest(F.coalesce("w", F.lit(1.0)), F.lit(0.0)))
        cap = F.when(F.col("weight") > 0, F.col("cap_%d" % depth)).otherwise(0)
        nodes.append(materialize(weighed.select(*names[:depth], "weight", cap.cast("long").alias("cap"), *(["tokens"] if depth == len(names) else [])), "mix-nodes"))
    nodes.reverse()
    upper = nodes[0].agg(F.least(F.sum("cap").cast("double"), budget).alias("given"))
    for depth, level in enumerate(nodes):
        parents = names[:depth]
        rows = level.crossJoin(F.broadcast(upper)) if not parents else _null_safe(level, upper, parents)
        by_need = Window.partitionBy(*parents).orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(float("inf")), *names[depth : depth + 1])
        before = F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
        rows = rows.withColumn("full", F.col("cap") * rest <= (F.col("given") - before) * F.col("weight"))
        whole = Window.partitionBy(*parents)
        fixed = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
        free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
        given = F.when(F.col("full"), F.col("cap").cast("double")).when(free > 0, (F.col("given") - fixed) * F.col("weight") / free).otherwise(0.0)
        upper = rows.withColumn("share", given).select(*names[: depth + 1], F.col("share").alias("given"), *(["tokens"] if depth == len(names) - 1 else []))
    return upper.select(*names, "tokens", F.floor("given").cast("long").alias("allowance"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(f"`{k}`").alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_r{i}"))
    return left.join(renamed, same).drop(*[f"_r{i}" for i in range(len(keys))])


def choose(rows: DataFrame, levels: tuple[str, ...] = LEVELS, weights: dict | None = None, share: float = BUDGET_SHARE, epochs: int = MAX_EPOCHS, seed: int = 11) -> DataFrame:
    """How often each document is used: ``rows`` (id, hash, levels, n_tokens) with ``copies`` and ``allowance``.

    Rows equal in id, hash and levels are decided on together. A leaf's documents are all used once for
    each whole time that its tokens go into its allowance; then, in the order that the seed and the number of
    this epoch give, those from the first on until the rest is reached.
    """
    names = list(levels)
    rows = materialize(rows.groupBy("id", "hash", *names).agg(F.sum("n_tokens").alias("n_tokens")), "mix-rows")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    total, most = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("docs"), F.lit(0))).first()
    allowed = materialize(budgets(leaves.drop("docs"), levels, WEIGHTS if weights is None else weights, F.lit(float(total) * share), epochs), "mix-budgets")
    met = _null_safe(rows, allowed, names)
    whole = F.when(F.col("tokens") > 0, F.expr("allowance DIV tokens")).otherwise(0)
    met = met.withColumn("whole", whole).withColumn("rest", F.col("allowance") - F.col("whole") * F.col("tokens"))
    met = met.withColumn("draw", F.md5(F.concat_ws("-", F.lit(seed), F.col("whole"), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    buckets = max(1, most // max(ROWS_PER_BUCKET, math.isqrt(most)))
    bucket = (F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * buckets / 2.0**32).cast("long")
    placed = running_total(met, names, ["draw", "id", "hash"], bucket, F.col("n_tokens"), "before", "mix-prefix")
    copies = F.col("whole") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)
    return placed.select("id", "hash", *names, "n_tokens", "allowance", copies.cast("long").alias("copies"))


def _keyed(df: DataFrame, levels: dict[str, Column], key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), *[c.cast("string").alias(k) for k, c in levels.items()], word_count(text).alias("n_tokens"))


def mix(df: DataFrame, levels: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with each row as often as the mixture uses it, not at all included, and ``epoch`` from 0.

    Tokens are words. ``levels`` are the columns of the tree from the root down. Null levels are nodes
    of their own, of weight 1. A node without tokens gets nothing and passes its share on. A weight of 0
    excludes a node. If all there is, ``epochs`` times, is less than the budget, all is taken. Documents
    are told apart by key and text; rows equal in both share a fate; null keys and null or
    empty texts (no tokens) are rows like others. Other columns pass through; one named epoch is
    replaced. Empty input: no rows.
    """
    levels = levels or {"domain": domain_of("source"), "lang": F.col("lang"), "source": F.col("source")}
    names = [c for c in df.columns if c != "epoch"]
    chosen = choose(_keyed(df, levels, key, text), tuple(levels), **options).where("copies > 0")
    chosen = materialize(chosen.select("id", "hash", *levels, "copies"), "mix-chosen")
    chosen = chosen.select(F.col("id").alias("_bw_id"), F.col("hash").alias("_bw_hash"), *[F.col(k).alias(f"_bw_{i}") for i, k in enumerate(levels)], F.col("copies").alias("_bw_copies"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_bw_id")) & (F.xxhash64(text) == F.col("_bw_hash"))
    for i, c in enumerate(levels.values()):
        same = same & c.cast("string").eqNullSafe(F.col(f"_bw_{i}"))
    out = [F.col(f"`{c}`") for c in names]
    return df.join(chosen, same).select(*out, F.explode(F.sequence(F.lit(0), (F.col("_bw_copies") - 1).cast("int"))).alias("epoch"))


def digest(documents: DataFrame) -> DataFrame:
    """Each document's leaf, tokens, the leaf's allowance, and how often it is used."""
    levels = {"domain": domain_of("source"), "lang": F.col("lang"), "source": F.col("source")}
    return choose(_keyed(documents, levels, "doc_id", "text")).select(F.col("id").alias("doc_id"), *levels, "n_tokens", "allowance", "copies")


def _level_sql(depth: int) -> str:
    """Water-filling among the children of each node of a level, as SQL."""
    names = LEVELS[: depth + 1]
    parents = ", ".join(LEVELS[:depth])
    part = f"PARTITION BY {parents}" if parents else ""
    up = f"JOIN got{depth - 1} g ON " + " AND ".join(f"n.{c} IS NOT DISTINCT FROM g.{c}" for c in LEVELS[:depth]) if parents else "CROSS JOIN got_root g"
    return f"""need{depth} AS (
  SELECT n.*, g.given, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM node{depth} n {up}
  WINDOW w AS ({part.replace(parents, ", ".join("n." + c for c in LEVELS[:depth])) if parents else ""} ORDER BY CASE WHEN weight > 0 THEN CAST(cap AS DOUBLE) / weight ELSE 'Infinity'::DOUBLE END, n.{names[-1]} NULLS FIRST)
), full{depth} AS (SELECT *, cap * rest <= (given - before) * weight AS is_full FROM need{depth}
), got{depth} AS (
  SELECT {", ".join(names)}, {"tokens, " if depth == len(LEVELS) - 1 else ""}CASE WHEN is_full THEN CAST(cap AS DOUBLE)
    WHEN sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}) > 0 THEN (given - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0)) * weight / sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}) ELSE 0 END AS given
  FROM full{depth}
)"""


def _weight_sql(depth: int) -> str:
    cases = " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(LEVELS, path)) + f" THEN {float(w)}" for path, w in WEIGHTS.items() if len(path) == depth + 1)
    return f"CASE {cases} ELSE 1.0 END" if cases else "1.0"


SQL = f"""
WITH doc AS (
  SELECT doc_id, lang, source, CASE WHEN regexp_full_match(source, 'src[0-9]+') THEN ['web', 'books', 'forum'][CAST(substr(source, 4) AS INT) % 3 + 1] ELSE 'other' END AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents
), leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM doc GROUP BY ALL
), node2 AS (SELECT *, CAST({_weight_sql(2)} AS DOUBLE) AS weight, CAST(tokens AS DOUBLE) * {MAX_EPOCHS} AS cap FROM leaf
), node1 AS (SELECT domain, lang, CAST({_weight_sql(1)} AS DOUBLE) AS weight, sum(cap) AS cap FROM node2 GROUP BY ALL
), node0 AS (SELECT domain, CAST({_weight_sql(0)} AS DOUBLE) AS weight, sum(cap) AS cap FROM node1 GROUP BY ALL
), got_root AS (SELECT least((SELECT sum(cap) FROM node0), (SELECT CAST(sum(tokens) AS DOUBLE) FROM leaf) * {BUDGET_SHARE}) AS given
), {", ".join(_level_sql(k) for k in range(3))}, leaves AS (
  SELECT domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(floor(given) AS BIGINT) AS allowance FROM got2
), met AS (
  SELECT d.*, l.tokens, l.allowance, CASE WHEN l.tokens > 0 THEN l.allowance // l.tokens ELSE 0 END AS whole
  FROM doc d JOIN leaves l ON d.domain IS NOT DISTINCT FROM l.domain AND d.lang IS NOT DISTINCT FROM l.lang AND d.source IS NOT DISTINCT FROM l.source
), placed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('-', 11, whole, coalesce(CAST(doc_id AS VARCHAR), 'null'))), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM met
)
SELECT doc_id, domain, lang, source, n_tokens, allowance, CAST(whole + CASE WHEN before < allowance - whole * tokens THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed
"""
