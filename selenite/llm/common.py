"""What several operators share: the shared folder, row keys, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session that names none (tests) gets one of its own; a cluster must name it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="selenite-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut lineage: write to the shared folder, read the table back.

    Survives the loss of any executor, unlike a local checkpoint. The table
    goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/selenite-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> F.Column:
    """64 bits of a text (XXH64, seed 42; null texts as empty).

    With the id it names a row, so rows with equal id and text are one row to
    the operators that join results back, and all get its result.
    """
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call outside glibc
        pass


def giving_way(keep: Sequence[str], *results: str) -> list[str]:
    """The kept columns without those that have a result's name: they give way to the result."""
    return [c for c in keep if c not in results]


def spare(name: str, taken: Sequence[str]) -> str:
    """``name``, lengthened until no column in ``taken`` has it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def concat_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    column = concat_column(column)
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(text).cast(pa.binary())
        ends = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(sizes).to_pylist()])
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by ``key`` so that no group is cut in two."""
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in key)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and not same(held[-1], held[-1].num_rows - 1, batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        last = batch.num_rows - 1
        changed = np.zeros(batch.num_rows, bool)
        for k in key:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
        at = int(np.flatnonzero(changed)[-1]) if changed.any() else 0
        if at:
            held.append(batch.slice(0, at))
            yield pa.Table.from_batches(held)
            held = [batch.slice(at, last - at + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, as (node, root).

    ``edges``: longs ``u``, ``v``. ``root`` is the smallest node reachable.
    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    each round joins every edge with the least neighbour of one of its ends, so
    no neighbourhood is ever gathered, and is written to the shared folder.
    Nodes without a link are not returned; an empty input gives no rows.
    """

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while (state := summary(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(least(both).withColumn("m", F.least("m", "u")), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = materialize(large)
        small = large.join(least(large), "u")
        now = materialize(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
    child = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return child.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
