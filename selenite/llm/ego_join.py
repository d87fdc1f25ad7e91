"""Near-duplicate vectors by the epsilon grid order join.

Cosine at least ``t`` means a distance of at most e = sqrt(2 - 2t) between unit
vectors. Distinct vectors are projected on the leading principal directions,
which never adds to a distance, and sorted by the grid cells of side e there. The
sequence is cut into blocks; intervals of the sequence are joined recursively, from
wide to narrow, and a pair of intervals goes on only if its bounding boxes lie
within e. Pairs of blocks that are left are compared in groups of their own, with
the same recursion inside, in double precision.

A group returns sums of links for each vector and a spanning forest, not its
pairs, and equal vectors are collapsed beforehand, so a large cluster costs
arithmetic but no rows. No link is lost: the projection and the boxes only rule out
pairs that are provably too far apart.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components has no links and is a component of its own; vectors of different
lengths never link; ids may be repeated (a component's id is its least non-null
id); equal vectors link with each other; other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenite.llm.common import components, concat_column, materialize

LEADING = 8
BLOCK = 4096
LEAF = 256
FAN = 8


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    column = concat_column(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def directions(vectors: DataFrame, size: int) -> np.ndarray:
    """Leading principal directions of all unit vectors; only sums of products come to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("vector")))
                total[:size] += x.T @ x
                total[size] += x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    n = vectors.count()
    rows = vectors.select("vector").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    total = np.zeros((size + 1) * size)
    for r in rows.collect():  # (size + 1) * size of them
        total[r["i"]] = r["v"]
    total = total.reshape(size + 1, size) / max(n, 1)
    _, axes = np.linalg.eigh(total[:size] - np.outer(total[size], total[size]))
    return axes[:, ::-1][:, : min(LEADING, size)].copy()


def box_gap(low_a, high_a, low_b, high_b) -> float:
    """Least squared distance between two boxes."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float((gap * gap).sum())


def ordered_blocks(vectors: DataFrame, axes: np.ndarray, side: float) -> DataFrame:
    """Blocks of the sequence in epsilon grid order, one row each: block, nodes, counts, data, low, high."""
    leading = axes.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.floor(unit(matrix(batch.column("vector"))) @ axes / side).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), leading).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "cell"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, k = [], 0
        for table in rebatched(batches, BLOCK):
            x = matrix(table.column("vector"))
            p = unit(x) @ axes
            held = [
                pa.array([table.column("part")[0].as_py()], pa.int32()),
                pa.array([k], pa.int64()),
                pa.array([table.column("node").to_pylist()], pa.list_(pa.int64())),
                pa.array([table.column("copies").to_pylist()], pa.list_(pa.int64())),
                pa.array([x.tobytes() if x.astype(np.float32).astype(np.float64).tobytes() != x.tobytes() else x.astype(np.float32).tobytes()], pa.binary()),
                pa.array([p.min(0).tolist()], pa.list_(pa.float64())),
                pa.array([p.max(0).tolist()], pa.list_(pa.float64())),
            ]
            k += 1
            yield pa.RecordBatch.from_arrays(held, ["part", "k", "nodes", "counts", "data", "low", "high"])

    sorted_rows = vectors.mapInArrow(project, "node long, copies long, vector array<double>, cell array<int>")
    keys = [F.col("cell")[i] for i in range(leading)] + [F.col("node")]
    sorted_rows = materialize(sorted_rows).repartitionByRange(*keys).sortWithinPartitions(*keys)
    sorted_rows = sorted_rows.withColumn("part", F.spark_partition_id()).drop("cell")
    schema = "part int, k long, nodes array<long>, counts array<long>, data binary, low array<double>, high array<double>"
    blocks = materialize(sorted_rows.mapInArrow(cut, schema))
    sizes = sorted((r["part"], r["count"]) for r in blocks.groupBy("part").count().collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    first = blocks.sparkSession.createDataFrame(starts, "part int, first long")
    return blocks.join(first, "part").withColumn("block", F.col("first") + F.col("k")).drop("part", "k", "first")


def rebatched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            take = min(size - n, batch.num_rows)
            held.append(batch.slice(0, take))
            batch, n = batch.slice(take), n + take
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def near_blocks(blocks: DataFrame, n: int, side: float, leading: int) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose boxes lie within ``side``: recursion over intervals of FAN**level blocks."""
    spark = blocks.sparkSession
    boxes = materialize(blocks.select("block", "low", "high"))
    level = max(1, math.ceil(math.log(max(n, 2), FAN)))
    pairs = spark.createDataFrame([(0, 0)], "a long, b long")
    for k in range(level - 1, -1, -1):
        width = FAN**k
        node = boxes.groupBy(F.floor(F.col("block") / width).cast("long").alias("i")).agg(
            *(F.min(F.col("low")[d]).alias(f"l{d}") for d in range(leading)),
            *(F.max(F.col("high")[d]).alias(f"h{d}") for d in range(leading)),
        )
        left = node.select(F.col("i").alias("a"), *(F.col(f"{s}{d}").alias(f"a{s}{d}") for s in "lh" for d in range(leading)))
        right = node.select(F.col("i").alias("b"), *(F.col(f"{s}{d}").alias(f"b{s}{d}") for s in "lh" for d in range(leading)))
        children = pairs.select(
            F.explode(F.sequence(F.col("a") * FAN, F.col("a") * FAN + FAN - 1)).alias("a"), F.col("b").alias("p")
        ).select("a", F.explode(F.sequence(F.col("p") * FAN, F.col("p") * FAN + FAN - 1)).alias("b"))
        gaps = [
            F.greatest(F.lit(0.0), F.col(f"al{d}") - F.col(f"bh{d}"), F.col(f"bl{d}") - F.col(f"ah{d}")) for d in range(leading)
        ]
        near = sum((g * g for g in gaps), F.lit(0.0)) <= side * side
        pairs = materialize(children.where("a <= b").join(left, "a").join(right, "b").where(near).select("a", "b"))
    return pairs


def leaf_pairs(low_a, high_a, low_b, high_b, i: tuple, j: tuple, limit: float, same: bool) -> Iterator[tuple[int, int]]:
    """Pairs of leaves of two blocks that are not provably distant, by halving the intervals."""
    if same and i[0] > j[0]:
        return
    boxes = low_a[i[0] : i[1]].min(0), high_a[i[0] : i[1]].max(0), low_b[j[0] : j[1]].min(0), high_b[j[0] : j[1]].max(0)
    if box_gap(*boxes) > limit:
        return
    if i[1] - i[0] == 1 and j[1] - j[0] == 1:
        yield i[0], j[0]
        return
    halves = lambda x: [x] if x[1] - x[0] == 1 else [(x[0], (x[0] + x[1]) // 2), ((x[0] + x[1]) // 2, x[1])]
    for u in halves(i):
        for v in halves(j):
            yield from leaf_pairs(low_a, high_a, low_b, high_b, u, v, limit, same)


def compare(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, threshold: float, side: float):
    """Links between two blocks (or within one): (links of each vector by leaf calls, forest edges).

    Yields (rows of x, rows of y, link matrix) for every pair of leaves with links.
    """
    same = y is None
    y = x if same else y
    a, b = unit(x), unit(y)
    bounds = []
    for p in (a @ axes, b @ axes):
        starts = np.arange(0, len(p), LEAF)
        bounds += [np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)]
    spans = (0, len(bounds[0])), (0, len(bounds[2]))
    for i, j in leaf_pairs(*bounds, *spans, side * side, same):
        r, c = np.arange(i * LEAF, min(len(a), (i + 1) * LEAF)), np.arange(j * LEAF, min(len(b), (j + 1) * LEAF))
        cosine = a[r] @ b[c].T
        for u, v in np.argwhere(np.abs(cosine - threshold) < 1e-9):  # decide the close ones by the plain formula
            s, t = x[r[u]], y[c[v]]
            cosine[u, v] = (s @ t) / (math.sqrt(s @ s) * math.sqrt(t @ t))
        linked = cosine >= threshold
        if same and i == j:
            np.fill_diagonal(linked, False)
        if linked.any():
            yield r, c, linked, same and i == j


def block_links(nodes: list, counts: list, data: list, axes: np.ndarray, threshold: float, side: float):
    """(node, links) sums and forest edges of a block (one entry in the lists) or of two."""
    same = len(nodes) == 1
    x = data[0]
    own = np.concatenate([np.array(n, np.int64) for n in nodes])
    copies = np.concatenate([np.array(c, np.int64) for c in counts])
    shift = 0 if same else len(x)
    links, label = np.zeros(len(own), np.int64), np.arange(len(own))
    left, right = [], []
    for r, c, linked, diagonal in compare(x, None if same else data[1], axes, threshold, side):
        links[r] += linked @ copies[c + shift]
        if not diagonal:
            links[c + shift] += linked.T @ copies[r]
        for u in np.flatnonzero(linked.any(1)):
            others = c[linked[u]] + shift
            labels, at = np.unique(label[others], return_index=True)
            new = labels != label[r[u]]
            if new.any():
                left += [int(own[r[u]])] * int(new.sum())
                right += own[others[at[new]]].tolist()
                label[np.isin(label, labels[new])] = label[r[u]]
    some = np.flatnonzero(links)
    return own[some], links[some], left, right


def near_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row of ``table``."""
    side = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    rows = table.select(F.col(id_column).alias("selenite_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable("v"), F.col("v")))
    distinct = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min("selenite_id").alias("least"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
    sizes = [r[0] for r in distinct.select(F.size("v")).distinct().collect()]
    spark = table.sparkSession
    found = spark.createDataFrame([], "node long, links long, u long, w long")
    for size in sorted(sizes):
        vectors = distinct.where(F.size("v") == size).select("node", "copies", F.col("v").alias("vector"))
        axes = directions(vectors, size)
        blocks = materialize(ordered_blocks(vectors, axes, side))
        pairs = near_blocks(blocks, blocks.count(), side, axes.shape[1])
        found = found.unionByName(joined(blocks, pairs, axes, size, threshold, side))
    found = materialize(found)
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    root = components(found.where("u is not null").select("u", F.col("w").alias("v")))
    known = distinct.join(links, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(known, "v", "left").withColumn("component_id", F.when(F.col("v").isNull(), F.col("selenite_id")).otherwise(F.col("component_id")))
    return out.select(
        F.col("selenite_id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("component_id").cast("long").alias("component_id"),
        F.coalesce(F.col("selenite_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def joined(blocks: DataFrame, pairs: DataFrame, axes: np.ndarray, size: int, threshold: float, side: float) -> DataFrame:
    """Rows (node, links) and (u, w) of all pairs of near blocks, each pair in a task of its own accord."""
    half = lambda x: blocks.select(F.col("block").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("nodes", "counts", "data")))
    both = pairs.join(half("a"), "a").join(half("b"), "b")
    both = both.repartition("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ends = "a" if row["a"] == row["b"] else "ab"
                data = []
                for e in ends:
                    raw, n = row[f"data_{e}"], len(row[f"nodes_{e}"])
                    kind = np.float32 if len(raw) == 4 * n * size else np.float64
                    data.append(np.frombuffer(raw, kind).astype(np.float64).reshape(n, size))
                node, links, u, w = block_links(
                    [row[f"nodes_{e}"] for e in ends], [row[f"counts_{e}"] for e in ends], data, axes, threshold, side
                )
                none = lambda k: pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(node), none(len(u))]),
                        pa.concat_arrays([pa.array(links), none(len(u))]),
                        pa.concat_arrays([none(len(node)), pa.array(u, pa.int64())]),
                        pa.concat_arrays([none(len(node)), pa.array(w, pa.int64())]),
                    ],
                    ["node", "links", "u", "w"],
                )

    return both.mapInArrow(run, "node long, links long, u long, w long")
