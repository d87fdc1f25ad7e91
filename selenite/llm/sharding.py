"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows lie in parts (the partitions they were read in). The cells of the matrix
say how many rows of each part go to each shard; they are drawn from the
multivariate hypergeometric law, which is what a uniform shuffle of all rows
would give, so every row sum is a part's size and every column sum a shard's
size exactly. Each part is permuted locally and dealt out by its row of the
matrix. The exchange deals a shard's rows to stretches by a seeded hash, about
``TARGET_ROWS`` rows to each, and every stretch is permuted again: a shard's order is
that of independent random keys, whose leading digit is the stretch, so it is uniform and no
shard is ever sorted in one task. The counts of the stretches give their first slots.

Only the sizes of the parts come to the driver: the matrix has parts x shards cells, drawn
a part at a time and distributed as a table. Permutations sort by a seeded hash of the
row's content and part, so a task that runs again deals its rows out alike.

Defined results: null texts have size 1 and the checksum of no bytes (0); shard
sizes differ by at most one row whatever the rows hold; equal rows are
interchangeable and each gets a slot of its own; ids may be null; columns of the input
named ``shard`` or ``slot`` give way to the results; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from selenite.llm.common import giving_way, materialize

TARGET_ROWS = 16_384


def communication_matrix(parts: list[int], targets: list[int], seed: int) -> np.ndarray:
    """Cells with the given row and column sums, as a uniform shuffle draws them."""
    rng = np.random.default_rng(seed)
    left = np.array(targets, np.int64)
    out = np.zeros((len(parts), len(targets)), np.int64)
    for i, n in enumerate(parts):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    return out


def even(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def shuffle(rows: DataFrame, shards: int = 16, seed: int = 42, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard).

    All columns are permuted and exchanged; hand in ids and sizes rather than texts.
    """
    spark = rows.sparkSession
    columns = giving_way(rows.columns, "shard", "slot")
    named = rows.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    held = materialize(named.withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in held.groupBy("part").count().collect())
    of_shard = even(sum(n for _, n in sizes), shards)
    ends = np.cumsum(communication_matrix([n for _, n in sizes], of_shard, seed), axis=1)
    deal = spark.createDataFrame([(p, e.tolist()) for (p, _), e in zip(sizes, ends, strict=True)], "part int, ends array<long>")
    stretches = max(1, -(-of_shard[0] // target_rows))

    content = [F.col(f"c{i}") for i in range(len(columns))]
    local = W.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit(1), "part", *content), *content)
    dealt = held.withColumn("n", F.row_number().over(local)).join(deal, "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("n")))).drop("ends")
    # a part and a place in it name a row, so these hashes are draws of its own
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "part", "n")
    dealt = dealt.withColumn("stretch", F.pmod(draw(2), F.lit(stretches)).cast("int"))
    first = dealt.groupBy("shard", "stretch").agg(F.count("*").alias("rows"))
    before = W.partitionBy("shard").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    first = first.select("shard", "stretch", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    again = W.partitionBy("shard", "stretch").orderBy(draw(3), "part", "n")
    placed = dealt.withColumn("place", F.row_number().over(again)).join(first, ["shard", "stretch"])
    slot = (F.col("first") + F.col("place") - 1).alias("slot")
    return placed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), "shard", slot)
