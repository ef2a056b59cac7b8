"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are rotated onto leading principal directions; vectors within cosine c of each
other are within eps = sqrt(2 - 2c) there too. Rows are sorted by label and grid cell (side
eps) of those coordinates and cut into blocks of bounded size. Blocks whose boxes are
farther apart than eps are never joined; a pair of blocks is joined by halving both
sequence intervals while their boxes are near, with dot products at the leaves. Equal
vectors are one row with a count, so a group of copies costs one row.

The directions are fitted on at most `sample` vectors: they steer what is skipped, and
never which links are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from markweave.llm.common import saved
from markweave.llm.components import components
from markweave.llm.simhash import _union

COSINE, DIMS, BLOCK, LEAF, SAMPLE = 0.98, 6, 1024, 64, 20_000
#: Neighbouring blocks of the sequence that are shipped together.
REACH = 8


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _units(m: np.ndarray) -> np.ndarray:
    scale = np.abs(m).max(1, keepdims=True)  # against overflow and underflow of squares
    m = m / scale
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def principal_directions(distinct: DataFrame, dims: int, sample: int) -> np.ndarray:
    """(width, dims) orthonormal columns from at most `sample` rows, the least by hash."""
    rows = distinct.select("emb").orderBy(F.xxhash64("cid")).limit(sample).toArrow()["emb"]
    if not len(rows):
        return np.zeros((0, dims))
    m = _units(_matrix(rows))
    _, vectors = np.linalg.eigh(np.cov(m, rowvar=False).reshape(m.shape[1], m.shape[1]) if len(m) > 1 else np.eye(m.shape[1]))
    return vectors[:, ::-1][:, :dims]


def _blocks(distinct: DataFrame, directions: np.ndarray, eps: float, block: int) -> DataFrame:
    """distinct in grid order with block (long): runs of at most `block` rows of a label."""
    dims = directions.shape[1]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = _units(_matrix(b.column(3))) @ directions
                grid = np.floor(at / eps).astype(np.int32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(grid.ravel()), dims).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], ["cid", "label", "n", "emb", "cell"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, used, current = TaskContext.get().partitionId() << 32, object(), 0, -1
        for b in batches:
            out, place = [], []
            for label in b.column(1).to_pylist():
                if label != last or used == block:
                    current, used, last = current + 1, 0, label
                out.append(first + current)
                place.append(used)
                used += 1
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.int64()), pa.array(place, pa.int32())], ["cid", "label", "n", "emb", "block", "place"])

    kind = distinct.schema["label"].dataType.simpleString()
    fields = f"cid long, label {kind}, n long, emb {distinct.schema['emb'].dataType.simpleString()}"
    gridded = distinct.select("cid", "label", "n", "emb").mapInArrow(cells, f"{fields}, cell array<int>")
    keys = ["label", *[F.col("cell")[i] for i in range(dims)], "cid"]
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(gridded.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(number, f"{fields}, block long, place int"), "blocks")


def _boxes(blocks: DataFrame, directions: np.ndarray) -> DataFrame:
    """(block, label, lo, hi) of each block's coordinates; partial boxes meet in an aggregate."""
    dims = directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = _units(_matrix(b.column(2))) @ directions
                ids = b.column(0).to_numpy()
                start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                lo, hi = np.minimum.reduceat(at, start), np.maximum.reduceat(at, start)
                as_list = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[start]), b.column(1).take(pa.array(start)), as_list(lo), as_list(hi)], ["block", "label", "lo", "hi"])

    kind = blocks.schema["label"].dataType.simpleString()
    part = blocks.select("block", "label", "emb").mapInArrow(run, f"block long, label {kind}, lo array<double>, hi array<double>")
    each = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
    return saved(part.groupBy("block", "label").agg(*each), "boxes")


def _near_blocks(boxes: DataFrame, dims: int, eps: float) -> DataFrame:
    """(a, b) with a <= b: blocks of a label whose boxes are within eps of each other. They
    are met on the cells of their two leading coordinates."""
    keyed = min(2, dims)

    def cells(side: str, wider: int) -> DataFrame:
        out = boxes.select(*[F.col(c).alias(f"{side}_{c}") for c in boxes.columns])
        for i in range(keyed):
            low, high = (F.floor(F.col(f"{side}_{e}{i}") / eps) for e in ("lo", "hi"))
            out = out.withColumn(f"{side}_c{i}", F.explode(F.sequence(low - wider, high + wider)))
        return out

    left, right = cells("a", 0), cells("b", 1)
    same = F.col("a_label") == F.col("b_label")
    for i in range(keyed):
        same = same & (F.col(f"a_c{i}") == F.col(f"b_c{i}"))
    gap = F.lit(0.0)
    for i in range(dims):
        d = F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"))
        gap = gap + d * d
    near = left.join(right, same & (F.col("a_block") <= F.col("b_block"))).where(gap <= eps * eps * (1 + 1e-9))
    return near.select(F.col("a_block").alias("a"), F.col("b_block").alias("b")).distinct()


def _leaf_pairs(at_a: np.ndarray, at_b: np.ndarray, eps: float, same: bool) -> list[tuple[slice, slice]]:
    """Intervals that may hold near rows, by halving both sequences while their boxes meet."""
    out, todo = [], [(0, len(at_a), 0, len(at_b))]
    limit = eps * eps * (1 + 1e-9)
    while todo:
        i, j, k, m = todo.pop()
        if same and k + (m - k) <= i:  # wholly below the diagonal: its mirror is done
            continue
        a, b = at_a[i:j], at_b[k:m]
        gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
        if gap @ gap > limit:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            out.append((slice(i, j), slice(k, m)))
            continue
        mid_a, mid_b = (i + j) // 2 if j - i > LEAF else j, (k + m) // 2 if m - k > LEAF else m
        todo += [(p, q, r, s) for p, q in ((i, mid_a), (mid_a, j)) if p < q for r, s in ((k, mid_b), (mid_b, m)) if r < s]
    return out


def _join(pairs: DataFrame, blocks: DataFrame, directions: np.ndarray, cosine: float) -> DataFrame:
    """(cid, other, links): links adds the counts of linked rows to cid; with other, an edge
    of the forest of a pair of reaches.

    A task gets two reaches of the sequence, in each the blocks that are near one of the
    other, once, however many they are near; it joins the sequences by halving."""
    eps = float(np.sqrt(2 - 2 * cosine))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns([c.removeprefix("r_") for c in right.column_names])
        order = [("block", "ascending"), ("place", "ascending")]
        left, right = left.sort_by(order), right.sort_by(order)
        a_ids, a_n, a = left["cid"].to_numpy(), left["n"].to_numpy(), _units(_matrix(left["emb"])) if left.num_rows else None
        same = not right.num_rows
        b_ids, b_n, b = (a_ids, a_n, a) if same else (right["cid"].to_numpy(), right["n"].to_numpy(), _units(_matrix(right["emb"])))
        links = np.zeros(len(a_ids) + (0 if same else len(b_ids)), np.int64)
        labels, base = np.arange(len(links)), 0 if same else len(a_ids)
        for i, j in _leaf_pairs(a @ directions, b @ directions, eps, same):
            x, y = np.nonzero(a[i] @ b[j].T >= cosine)
            x, y = x + i.start, y + j.start
            if same:
                x, y = x[x < y], y[x < y]
            np.add.at(links, x, b_n[y])
            np.add.at(links, y + base, a_n[x])
            _union(labels, x, y + base)
        ids = a_ids if same else np.concatenate([a_ids, b_ids])
        some, moved = np.flatnonzero(links), np.flatnonzero(labels != np.arange(len(labels)))
        other = pa.array([None] * len(some) + ids[labels[moved]].tolist(), pa.int64())
        return pa.table({"cid": pa.array(np.concatenate([ids[some], ids[moved]])), "other": other, "links": pa.array(np.concatenate([links[some], np.zeros(len(moved), np.int64)]))})

    reach = lambda c: F.floor(F.col(c) / REACH)
    of = pairs.select("a", "b", reach("a").alias("ra"), reach("b").alias("rb"))
    inside = F.col("ra") == F.col("rb")
    rows = blocks.select("block", "label", "place", "cid", "n", "emb")
    sides = []
    for blocks_of in (of.select("ra", "rb", F.explode(F.when(inside, F.array("a", "b")).otherwise(F.array("a"))).alias("_b")), of.where(~inside).select("ra", "rb", F.col("b").alias("_b"))):
        sides.append(blocks_of.distinct().join(rows, F.col("_b") == F.col("block")).drop("_b"))
    left, right = sides
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    # A reach may hold the ends of two labels, which are never joined.
    return left.groupBy("ra", "rb", "label").cogroup(right.groupBy("r_ra", "r_rb", "r_label")).applyInArrow(run, "cid long, other long, links long")


def near_vectors(rows: DataFrame, cosine: float = COSINE, dims: int = DIMS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row per row of rows (vec_id, label, embedding): vec_id, n_links, component_id,
    kept (vec_id is the least of its component).

    Links join rows of one label, not null, with a cosine of at least `cosine`, in double
    precision. A vector that is null, empty, zero or holds a null or non-finite number
    links with nothing, nor do vectors of different lengths. Equal vectors are linked
    with each other. Rows that repeat a vec_id are vectors of their own. An empty table
    gives no rows; other columns are not used.
    """
    # Single numbers are exact as they are; all others are taken as doubles.
    kind = "array<float>" if rows.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    base = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["label"].alias("label"), rows["embedding"].cast(kind).alias("emb"))
    sound = F.expr("label IS NOT NULL AND emb IS NOT NULL AND forall(emb, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(emb, x -> x <> 0)")
    valid = base.where(F.coalesce(sound, F.lit(False)))
    distinct = saved(valid.groupBy("label", "emb").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()), "vectors")
    found = None
    for (width,) in distinct.select(F.size("emb")).distinct().collect():
        of = distinct.where(F.size("emb") == width)
        directions = principal_directions(of, min(dims, width), sample)
        eps = float(np.sqrt(2 - 2 * cosine))
        blocks = _blocks(of, directions, eps, block)
        pairs = saved(_near_blocks(_boxes(blocks, directions), directions.shape[1], eps), "block-pairs")
        some = _join(pairs, blocks, directions, cosine)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = saved(found, "vector-links")
    links = found.where("other IS NULL").groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    of = distinct.join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = of.join(least, "root").select(F.col("label").alias("_l"), F.col("emb").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return base.join(classes, (F.col("label") == F.col("_l")) & (F.col("emb") == F.col("_e")), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")), F.lit(True)).alias("kept"),
    )
