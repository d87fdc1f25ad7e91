"""Nearest neighbours by inner product from a forest of random-projection trees.

Each tree halves a bounded sample again and again at the median of a projection on
the difference of two random vectors, until a node holds LEAF rows of the sample. An added
coordinate makes all vectors equally long, so that a large inner product means a
small distance. Every row goes down every tree and is indexed in one leaf of each.

A query keeps one priority queue for all trees: the node whose splitting planes it
violates least (sum of squared margins) is opened next, whichever tree it is in. So
many leaves are opened as a bounded number of probe queries, compared with all rows, need
for the recall asked for. Queries and rows then meet by leaf, large leaves and
leaves of many queries in several parts, and the candidates are ranked by exact
inner products of the original vectors. A first round over the best leaves gives each
query a bound, so that the second sends on little more than the result.

What comes to the driver: the forest and the sizes of its leaves (SAMPLE numbers at most fit it), and the
neighbours of PROBES queries. Vectors that occur often are indexed as their k + 1 least ids, which is
enough for any answer; queries with equal vectors are searched once.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components takes no part, nor does a row without an id; of rows that share an id
the one with the least vector stands; vectors of different lengths are never
compared; ties go to the smaller id; other columns are not read; an id column may have any name;
a query with fewer than k candidates gets all of them; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenite.llm.common import concat_column, materialize

TREES = 4
#: Numbers (rows times length) of the sample that the trees are fitted on, at most.
SAMPLE = 2**23
LEAF = 512
#: Recall that the probe queries must reach, and their number.
RECALL = 0.95
PROBES = 256
#: Leaves of the first round, and rows and queries that meet in one group.
FIRST = 4
ROWS = 16_384
QUERIES = 16_384
SEED = 11


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = concat_column(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


class Space:
    """Vectors scaled, with a coordinate that makes them equally long; queries have 0 there."""

    def __init__(self, largest: float, longest: float):
        self.largest, self.longest = largest, longest

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1, keepdims=True)))])

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x / self.largest, np.zeros((len(x), 1))])


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> dict:
    """A tree over the rows of ``x``: planes, offsets and children; a child below zero is the leaf ~child."""
    planes, offsets, children, leaves = [], [], [], 0
    waiting = [(np.arange(len(x)), None, 0)]
    while waiting:
        rows, above, side = waiting.pop()
        split = cut(x, rows, rng) if len(rows) > leaf else None
        if split is None:
            here, leaves = ~leaves, leaves + 1
        else:
            here = len(planes)
            planes.append(split[0])
            offsets.append(split[1])
            children.append([0, 0])
            waiting += [(rows[~split[2]], here, 0), (rows[split[2]], here, 1)]
        if above is not None:
            children[above][side] = here
    return {
        "planes": np.array(planes).reshape(-1, x.shape[1]),
        "offsets": np.array(offsets, float),
        "children": np.array(children, np.int64).reshape(-1, 2),
        "leaves": leaves,
    }


def cut(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator):
    """Plane, offset and side of each row, or None where no two different rows were drawn."""
    for _ in range(20):
        a, b = x[rng.choice(rows, 2, replace=False)]
        plane = a - b
        if (length := np.sqrt(plane @ plane)) > 0:
            plane = plane / length
            along = x[rows] @ plane
            for offset in (np.median(along), (a + b) @ plane / 2):
                right = along > offset
                if right.any() and not right.all():
                    return plane, float(offset), right
    return None


def leaf_of(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), np.int64) if len(tree["planes"]) else np.full(len(x), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        right = (x[inner] * tree["planes"][node]).sum(1) > tree["offsets"][node]
        at[inner] = tree["children"][node, right.astype(int)]
    return ~at


def openings(forest: list[dict], q: np.ndarray) -> Iterator[Iterator[tuple[int, int]]]:
    """For each query the (tree, leaf) pairs in the order of the shared queue."""
    margins = [(q @ t["planes"].T - t["offsets"]).tolist() if len(t["planes"]) else [[]] * len(q) for t in forest]
    children = [t["children"].tolist() for t in forest]

    def one(k: int) -> Iterator[tuple[int, int]]:
        queue = [(0.0, t, 0 if children[t] else -1) for t in range(len(forest))]
        while queue:
            cost, t, node = heapq.heappop(queue)
            while node >= 0:  # the near side costs nothing more, so it is opened at once
                m = margins[t][k][node]
                left, right = children[t][node]
                near, far = (right, left) if m > 0 else (left, right)
                heapq.heappush(queue, (cost + m * m, t, far))
                node = near
            yield t, ~node

    return (one(k) for k in range(len(q)))


def visits(forest: list[dict], q: np.ndarray, counts: list[list[int]], opened: int, least: int) -> list[list[tuple[int, int]]]:
    """The leaves of each query: ``opened`` of them, and on until one tree has given ``least`` rows."""
    out = []
    for order in openings(forest, q):
        found, seen = [], [0] * len(forest)
        for t, leaf in order:
            found.append((t, leaf))
            seen[t] += counts[t][leaf]
            if len(found) >= opened and max(seen) >= least:
                break
        out.append(found)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, added up from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def best(q: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(query row, id, score): the k best rows of ``x`` for each query, none below its bound; ties to the smaller id."""
    slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max(initial=0.0))
    for at in range(0, len(q), 1024):
        s = q[at : at + 1024] @ x.T
        least = bound[at : at + 1024]
        if s.shape[1] > k:
            least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        u, v = np.nonzero(s >= (least - slack[at : at + 1024])[:, None])
        score = products(q[at + u], x[v])
        order = np.lexsort((ids[v], -score, u))
        u, v, score = u[order], v[order], score[order]
        first = np.searchsorted(u, u)  # u is sorted
        keep = (np.arange(len(u)) - first < k) & (score >= bound[at + u])
        yield at + u[keep], ids[v[keep]], score[keep]


def fit_forest(rows: DataFrame, count: int, size: int, space: Space) -> list[dict]:
    """TREES trees, each fitted in a task of its own on a sample of SAMPLE numbers at most."""
    share = min(1.0, SAMPLE / size / max(count, 1))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(2**31)) <= F.lit(int(share * 2**31))).select("vec_id", "v")
    sample = sample.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    leaf = LEAF

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        t = key[0].as_py()
        x = matrix(table.column("v"))[np.argsort(table.column("vec_id").to_numpy())]  # the same at every run
        tree = grow(space.rows(x), leaf, np.random.default_rng([SEED, t]))
        return pa.table({"tree": pa.array([t], pa.int32()), "body": pa.array([pickle.dumps(tree)], pa.binary())})

    found = sample.groupBy("tree").applyInArrow(fit, "tree int, body binary").orderBy("tree").collect()
    return [pickle.loads(r["body"]) for r in found]


def indexed(rows: DataFrame, forest: list[dict], space: Space) -> DataFrame:
    """``rows`` with the leaf in every tree."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = space.rows(matrix(batch.column("v")))
                leaves = np.stack([leaf_of(t, x) for t in forest], 1).astype(np.int32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel()), len(forest)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "leaves"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.select("vec_id", "v").mapInArrow(route, f"vec_id long, v {kind}, leaves array<int>")


def leaves_needed(index: DataFrame, queries: DataFrame, forest: list[dict], space: Space, k: int, recall: float) -> int:
    """Leaves to open so that the probe queries find ``recall`` of their true neighbours."""
    total = queries.count()
    share = int(min(1.0, PROBES / max(total, 1)) * 2**31)
    probes = queries.where(F.pmod(F.xxhash64("least"), F.lit(2**31)) <= share).select("least", "v").orderBy("least").limit(2 * PROBES).collect()
    if not probes:
        return 1
    q, own = np.array([r["v"] for r in probes], float), np.array([r["least"] for r in probes])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, ids = matrix(batch.column("v")), batch.column("vec_id").to_numpy()
                places = np.argsort(ids)
                for u, found, score in best(q, np.full(len(q), -np.inf), x, ids, k + 1):
                    other = found != own[u]
                    rows = places[np.searchsorted(ids[places], found[other])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u[other], pa.int32()), pa.array(found[other]), pa.array(score[other]), batch.column("leaves").take(pa.array(rows))],
                        ["probe", "vec_id", "score", "leaves"],
                    )

    best_first = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    near = index.mapInArrow(top, "probe int, vec_id long, score double, leaves array<int>")
    near = near.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    place = [{pair: i for i, pair in enumerate(order)} for order in openings(forest, space.queries(q))]
    needed = sorted(min(place[r["probe"]][t, leaf] for t, leaf in enumerate(r["leaves"])) for r in near.select("probe", "leaves").collect())
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1 if needed else 1


def searched(queries: DataFrame, forest: list[dict], space: Space, counts: list[list[int]], opened: int, least: int) -> DataFrame:
    """(q, v, tree list, leaf list) of every query, best leaves first."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = visits(forest, space.queries(matrix(part.column("v"))), counts, opened, least)
                lists = [pa.array([[x[s] for x in f] for f in found], pa.list_(pa.int32())) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("v"), *lists], ["q", "v", "trees", "leaves"])

    kind = queries.schema["v"].dataType.simpleString()
    return queries.select("q", "v").mapInArrow(route, f"q long, v {kind}, trees array<int>, leaves array<int>")


def meet(index: DataFrame, asked: DataFrame, sizes: DataFrame, k: int, parts: Column | None = None) -> DataFrame:
    """(q, vec_id, score): the k best candidates of every leaf that a query opens, none below the query's bound.

    ``asked``: q, bound, v, tree, leaf, one row for each leaf opened. ``sizes``: rows of each leaf. A group holds
    about ROWS rows and QUERIES queries of one leaf. ``parts``: how many of a leaf's parts are looked at (all).
    """
    loads = asked.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
    sizes = F.broadcast(sizes.join(F.broadcast(loads), ["tree", "leaf"]))  # at most SAMPLE / LEAF leaves a tree
    rows = index.select("vec_id", "v", F.posexplode("leaves").alias("tree", "leaf")).join(sizes, ["tree", "leaf"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    last = (F.col("parts") if parts is None else F.least("parts", parts)) - 1
    asked = asked.join(sizes, ["tree", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    asked = asked.withColumn("share", F.pmod(F.xxhash64("q"), F.col("shares")).cast("int"))
    keys = ["tree", "leaf", "part", "share"]

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if left.num_rows and right.num_rows:
            q, ids = right.column("q").to_numpy(), left.column("vec_id").to_numpy()
            for u, found, score in best(matrix(right.column("v")), right.column("bound").to_numpy(), matrix(left.column("v")), ids, k):
                out.append((q[u], found, score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("q", "vec_id", "score"), columns, strict=True)))

    rows, asked = rows.select(*keys, "vec_id", "v").groupBy(*keys), asked.select(*keys, "q", "bound", "v").groupBy(*keys)
    return rows.cogroup(asked).applyInArrow(rank, "q long, vec_id long, score double")


def neighbours(table: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows found for each row for which ``is_query`` holds.

    ``is_query`` speaks of the table's columns and must follow from the id.
    """
    kind = "array<float>" if table.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("v")).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    rows = materialize(rows.withColumn("size", F.size("v")))
    out = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size in sorted(r[0] for r in rows.select("size").distinct().collect()):
        out = out.unionByName(neighbours_of_size(rows.where(F.col("size") == size).drop("size"), size, k, recall))
    return out


def neighbours_of_size(rows: DataFrame, size: int, k: int, recall: float) -> DataFrame:
    """The vectors of one length."""
    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.select("vec_id", "v").withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    kept = materialize(kept)
    largest = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    count, largest = kept.agg(F.count("*"), F.max(largest)).first()
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + (c / largest) * (c / largest)))
    space = Space(largest, kept.agg(F.max(length)).first()[0])
    queries = rows.where("asks").groupBy("v").agg(F.min("vec_id").alias("least"))
    queries = materialize(queries.withColumn("q", F.monotonically_increasing_id()))

    forest = fit_forest(kept, count, size, space)
    index = materialize(indexed(kept, forest, space))
    held = index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count()
    counts = [[0] * t["leaves"] for t in forest]
    sizes = held.collect()  # at most SAMPLE / LEAF leaves a tree
    for r in sizes:
        counts[r["tree"]][r["leaf"]] = r["count"]
    parts = [(r["tree"], r["leaf"], -(-r["count"] // ROWS)) for r in sizes]
    parts = rows.sparkSession.createDataFrame(parts, "tree int, leaf int, parts int")

    opened = leaves_needed(index, queries, forest, space, k, recall)
    asked = materialize(searched(queries, forest, space, counts, opened, k + 1))
    pairs = lambda some: some.select("q", "v", "bound", F.explode(F.arrays_zip("trees", "leaves")).alias("p")).select("q", "v", "bound", "p.*").withColumnsRenamed({"trees": "tree", "leaves": "leaf"})
    first = asked.select("q", "v", F.lit(float("-inf")).alias("bound"), F.slice("trees", 1, FIRST).alias("trees"), F.slice("leaves", 1, FIRST).alias("leaves"))
    bounds = ranked(meet(index, pairs(first), parts, k + 1, parts=F.lit(1)), k + 1)
    bounds = bounds.where(F.size("found") > k).select("q", F.element_at("found", -1)["score"].alias("bound"))
    second = asked.join(bounds, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    found = ranked(meet(index, pairs(materialize(second)), parts, k + 1), k + 1)

    found = queries.join(found, "q").select("v", "found")
    out = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").join(found, "v")
    own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    out = out.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(q, found): the k best different rows of each query, best first."""
    once = pairs.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score")))
    return top.groupBy("q").agg(found.alias("found"))
