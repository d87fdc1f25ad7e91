"""Connected components by hooking and pointer doubling.

Each round hooks every node to its least neighbour, follows the pointers, doubling their reach, until all
end at a root, and goes on with the edges between roots. Long paths take a logarithmic number of steps, and no
neighbourhood is gathered. Every step is written to a shared folder, so lost executors cost a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root): ``root`` is one node of the component, the same for all of it. ``edges``: longs u, v.

    Nodes without an edge to another are not returned. ``folder``: new and shared.
    """
    spark, written = edges.sparkSession, 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal written
        written += 1
        df.write.parquet(f"{folder}/{written}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{written}")

    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = keep(both(edges.select("u", "v").where("u <> v")).distinct())
    labels = keep(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    while not now.isEmpty():
        hooked = keep(now.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("r")))
        while True:
            above = hooked.select(F.col("u").alias("r"), F.col("r").alias("rr"))
            doubled = keep(hooked.join(above, "r", "left").select("u", F.coalesce("rr", "r").alias("r"), (F.coalesce("rr", "r") != F.col("r")).alias("moved")))
            hooked = doubled.drop("moved")
            if doubled.where("moved").isEmpty():
                break
        to = hooked.select(F.col("u").alias("root"), "r")
        labels = keep(labels.join(to, "root", "left").select("node", F.coalesce("r", "root").alias("root")))
        ends = [hooked.select(F.col("u").alias(c), F.col("r").alias(f"r{c}")) for c in "uv"]
        now = keep(now.join(ends[0], "u").join(ends[1], "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")).where("u <> v").distinct())
    return labels
