"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, connected_components, materialize
from .kdtree import usable

#: Bytes of the vectors of a cell, about, and of one side of a block product at most; rows of one strip of a product.
CELL_BYTES, BLOCK_BYTES, STRIP_ROWS = 4 << 20, 16 << 20, 256
#: Centres of a label at most; what a vector is compared with to be placed. Cells of a label larger than that times CELL_BYTES grow and are sliced.
MAX_CENTRES = 4096
#: Distinct vectors that a centre is fitted on, about, and bytes of all of a label's: the documented bound of the sample.
SAMPLE_ROWS, SAMPLE_BYTES = 32, 128 << 20
#: Distinct vectors of a label that one task places; bytes of the cosines that it holds at a time.
SLICE_ROWS, HELD_BYTES = 16384, 32 << 20


def _strips(n: int, columns: int) -> Iterator[slice]:
    """Rows whose products with so many columns stay within HELD_BYTES."""
    step = max(1, HELD_BYTES // (8 * max(columns, 1)))
    for lo in range(0, n, step):
        yield slice(lo, min(n, lo + step))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's nearest centre and its cosine with that."""
    home, cosine = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for rows in _strips(len(x), len(centres)):
        near = x[rows] @ centres.T
        home[rows] = near.argmax(axis=1)
        cosine[rows] = near.max(axis=1)
    return home, cosine


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centres of unit vectors."""
    draw = np.random.default_rng(seed)
    c = x[draw.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home, _ = nearest(x, c)
        order = np.argsort(home, kind="stable")
        first = np.flatnonzero(np.diff(home[order], prepend=-1))
        sums = np.zeros_like(c)
        sums[home[order][first]] = np.add.reduceat(x[order], first, axis=0)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def meeting(centres: np.ndarray, least: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of cells, a before or equal to b, that may hold vectors within ``threshold`` of each other.

    All of a cell's vectors lie within an angle of its centre, of which ``least`` is the cosine. Angles on a sphere obey the
    triangle's rule, so cells whose centres are further apart than both angles and the threshold's have no such pair.
    """
    reach = np.arccos(np.clip(least, -1, 1))
    a, b = [], []
    for rows in _strips(len(centres), 3 * len(centres)):
        apart = np.arccos(np.clip(centres[rows] @ centres.T, -1, 1))
        i, j = np.nonzero(apart <= reach[rows][:, None] + reach[None, :] + np.arccos(threshold) + 1e-6)
        i = i + rows.start
        a.append(i[i <= j])
        b.append(j[i <= j])
    return np.concatenate(a), np.concatenate(b)


def _vectors(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _placed(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes in their cells; and the pairs of cells to compare, each both ways round.

    Every label of two classes or more has two centres at least, fitted on a sample of bounded size in a task
    of its own. The classes of a label are dealt out in slices, each of which gets the label's centres.
    """
    where = ["label", "dim"]
    kind = classes.schema["label"].dataType.simpleString()
    k = F.least(F.greatest(F.expr(f"n * dim * 8 DIV {CELL_BYTES}"), F.lit(2)), F.lit(MAX_CENTRES), F.col("n"))
    sizes = classes.groupBy(*where).agg(F.count("*").alias("n")).withColumn("k", k.cast("int"))
    sizes = materialize(sizes.withColumn("slices", F.ceil(F.col("n") / SLICE_ROWS).cast("int")), "embed-labels")
    share = F.least(F.col("k") * SAMPLE_ROWS, F.lit(SAMPLE_BYTES) / (8 * F.col("dim"))) / F.col("n")
    drawn = classes.select(*where, "cid", "v").join(sizes.select(*where, "k", share.alias("share")), where)
    drawn = drawn.where(F.shiftrightunsigned(F.xxhash64("cid"), 11) * F.lit(2.0**-53) < F.col("share")).select(*where, "k", "v")

    def train(group: pa.Table) -> pa.Table:
        c = spherical_kmeans(_unit(_vectors(group["v"], group.num_rows)), group["k"][0].as_py())
        return pa.table({"label": group["label"][:1], "dim": group["dim"][:1], "centres": pa.array([c.reshape(-1).tolist()], pa.list_(pa.float64()))})

    centres = materialize(drawn.groupBy(*where).applyInArrow(train, f"label {kind}, dim int, centres array<double>"), "embed-centres")
    dealt = centres.join(sizes.select(*where, "slices"), where).select(*where, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "centres")
    rows = classes.join(sizes.select(*where, "slices"), where).select(*where, F.pmod(F.xxhash64("cid"), F.col("slices")).cast("int").alias("slice"), "cid", "mult", "v")

    def place(group: pa.Table, told: pa.Table) -> pa.Table:
        n = group.num_rows
        home, cosine = np.zeros(n, dtype=np.int64), np.full(n, -1.0)
        if n and told.num_rows:  # else the sample has missed a label of few classes: one cell, as wide as can be
            home, cosine = nearest(_unit(_vectors(group["v"], n)), np.array(told["centres"][0].as_py()).reshape(-1, group["dim"][0].as_py()))
        return group.drop_columns(["slice"]).append_column("cell", pa.array(home.astype(np.int32))).append_column("cosine", pa.array(cosine))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "slice")
    placed = rows.groupBy(*where, "slice").cogroup(dealt.groupBy(*where, "slice")).applyInArrow(place, f"{schema}, cell int, cosine double")
    placed = materialize(placed, "embed-placed")
    parts = F.ceil(F.count("*") * F.col("dim") * 8 / BLOCK_BYTES).cast("int")
    held = materialize(placed.groupBy(*where, "cell").agg(F.min("cosine").alias("least"), parts.alias("parts")), "embed-cells")

    def pair(cells: pa.Table, told: pa.Table) -> pa.Table:
        cell = cells["cell"].to_numpy()
        if told.num_rows and len(cell):
            c = np.array(told["centres"][0].as_py()).reshape(-1, cells["dim"][0].as_py())
            a, b = meeting(c[cell], cells["least"].to_numpy(), threshold)
        else:
            a, b = np.triu_indices(len(cell))
        a, b = np.concatenate([a, b[a != b]]), np.concatenate([b, a[a != b]])
        at = pa.array(np.zeros(len(a), dtype=np.int64))
        fields = [cells[c].combine_chunks().take(at) if len(a) else cells[c].combine_chunks() for c in where]
        return pa.table([*fields, pa.array(cell[a]), pa.array(cells["parts"].to_numpy()[a]), pa.array(cell[b]), pa.array(cells["parts"].to_numpy()[b])], names=[*where, "cell", "own", "other", "parts"])

    pairs = held.groupBy(*where).cogroup(centres.groupBy(*where)).applyInArrow(pair, f"label {kind}, dim int, cell int, own int, other int, parts int")
    return placed, materialize(pairs, "embed-pairs")


def _compared(placed: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``cid, other, n``: n linked vectors of a class (other null), or a link of a forest that joins all linked classes (n null).

    A class goes to a task for each block of each cell that its own must be compared with. A cell larger than a block is
    several, by hash.
    """
    where = ["label", "dim"]
    rows = placed.select(*where, "cell", "cid", "mult", "v").join(pairs, [*where, "cell"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("own")).cast("int"))
    rows = rows.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    mine, theirs = F.struct(F.col("cell").alias("cell"), F.col("block").alias("block")), F.struct(F.col("other").alias("cell"), F.col("facing").alias("block"))
    tasks = rows.select(*where, F.least(mine, theirs).alias("a"), F.greatest(mine, theirs).alias("b"), (mine <= theirs).alias("left"), "cid", "mult", "v")

    def task(t: pa.Table) -> pa.Table:
        x, cid, mult = _vectors(t["v"], t.num_rows), t["cid"].to_numpy(), t["mult"].to_numpy()
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
        norm = np.sqrt((x * x).sum(axis=1))
        alone = t["a"][0].as_py() == t["b"][0].as_py()
        first = t["left"].to_numpy(zero_copy_only=False)
        left = np.flatnonzero(first)
        right = left if alone else np.flatnonzero(~first)
        n, forest = np.zeros(len(x), dtype=np.int64), Forest(len(x))
        for lo in range(0, len(left), STRIP_ROWS):
            rows = left[lo : lo + STRIP_ROWS]
            hit = (x[rows] @ x[right].T) / (norm[rows][:, None] * norm[right][None, :]) >= threshold
            hit &= cid[rows][:, None] != cid[right][None, :]
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            np.add.at(n, rows[i], mult[right[j]])
            if not alone:
                np.add.at(n, right[j], mult[rows[i]])
            forest.join(rows[i], right[j])
        linked, moved = np.flatnonzero(n), np.flatnonzero(forest.label != np.arange(len(x)))
        return pa.table({"cid": np.concatenate([cid[linked], cid[moved]]), "other": pa.array([None] * len(linked) + cid[forest.label[moved]].tolist(), pa.int64()), "n": pa.array(n[linked].tolist() + [None] * len(moved), pa.int64())})

    return tasks.groupBy(*where, "a", "b").applyInArrow(task, "cid long, other long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, n_links, component_id, kept`` of each row: rows of one label are linked at cosine ``threshold`` or more.

    Equal vectors of a label are one class from the start, whatever their number. Centres are fitted on a
    bounded sample for each label; each class is placed in its nearest centre's cell, and cells are compared with themselves
    and with those that the geometry does not rule out, so that no link is lost. Cells are
    compared in products of blocks of bounded size; tasks return how many vectors each class is linked
    with and a forest of links, never the pairs. The row with a component's least key is kept.

    Rows whose label is null, or whose vector is null, empty, zero or holds a null or non-finite component
    link with nothing: no links, a component of their own. Vectors of different length do not link. Rows
    that repeat are linked with each other. Null keys count as none. Empty input: no rows. Other
    columns do not matter.
    """
    ok = usable(vector) & F.col(label).isNotNull() & F.exists(F.col(vector), lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("key"), F.when(F.coalesce(ok, F.lit(False)), F.col(vector)).alias("v"), F.col(label).alias("label"))
    classes = rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.count("*").alias("mult"), F.min("key").alias("least"))
    classes = materialize(classes.withColumn("dim", F.size("v")).withColumn("cid", F.monotonically_increasing_id()), "embed-classes")
    found = materialize(_compared(*_placed(classes, threshold), threshold), "embed-found")
    others = found.where("n IS NOT NULL").groupBy("cid").agg(F.sum("n").alias("n"))
    member = connected_components(found.where("n IS NULL").select(F.col("cid").alias("src"), F.col("other").alias("dst")))
    named = classes.join(others, "cid", "left").join(member, F.col("cid") == F.col("node"), "left")
    named = materialize(named.select("label", "v", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "cid").alias("root")), "embed-rooted")
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "embed-least")
    named = materialize(named.join(least, "root").select("label", "v", "n_links", "component_id"), "embed-named")
    out = rows.join(named, ["label", "v"], "left").select("key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("v").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def digest(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
"""
