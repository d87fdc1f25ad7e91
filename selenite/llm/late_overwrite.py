"""Days of sorted files, and rows that arrive late: the files of their days are written anew, no others.

A layout keeps of each id the row that arrived last, and cuts every day, sorted by
time and id, into Parquet files of equal numbers of rows (the last of a day may hold
fewer), one folder a day and file.

Late rows are joined with the ids that stand: what they replace goes out, also from
other days. In the days concerned, the stored rows, the outgoing ids and the incoming rows are cogrouped
by (day, fixed time slice) in one exchange and merged there in order of time and id, where an
outgoing id stands right behind the row that it takes away. Prefix sums of the slices'
counts give every row its place in the day and so its file. Spark's dynamic partition
overwrite then puts the new files in the place of the old ones when all are written, and
files past a day's new end are removed.

A slice that holds more than a file's rows is cut further at quantiles of its times and, within one
time, of its ids, so that a third of all rows at one time still spreads over many
tasks; there are some 2,000 such cuts at most, by the share of all rows that makes
a slice large. A file is written by one task, row by row. Only the number of rows of each day
concerned comes to the driver.

Defined results: a null time stands in day -1; a null arrival is before all others, and late;
equal arrivals are settled by a hash of the row, so equal rows count once; null ids are one id, placed
first among equal times; ids are whole numbers; timestamps without a zone are read as UTC whatever the session's
zone is; columns may have any names but must be of kinds that Spark orders and hashes; an
empty table gives a folder without data files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.llm.common import materialize

DAY = 86_400_000_000
#: Microseconds of a slice.
SLICE = DAY // 24
#: A slice with more than this part of the rows, and more than a file's, is cut; into so many parts at most.
SHARE = 1000
STORED, OUTGOING, INCOMING = 0, 1, 2
GROUP = ["day", "slice", "at", "part"]


@dataclass(frozen=True)
class Layout:
    """Where the files are, which columns tell id, time and arrival, and a file's rows."""

    path: str
    schema: T.StructType
    id: str
    time: str
    arrival: str
    rows_per_file: int

    def folders(self) -> tuple[str, str]:
        """Names of the partition folders: no column's name."""
        taken = {f.name.lower() for f in self.schema}
        out = []
        for name in ("layout_day", "layout_file"):
            while name in taken:
                name += "_"
            out.append(name)
        return out[0], out[1]


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 in UTC of a timestamp, with or without a zone."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.unix_micros(c)
    seconds = F.expr(f"cast(extract(second from `{column}`) * 1000000 as long)")
    return F.unix_date(c.cast("date")).cast("long") * DAY + (F.hour(c) * 60 + F.minute(c)).cast("long") * (DAY // 1440) + seconds


def keyed(rows: DataFrame, layout: Layout) -> DataFrame:
    """(id, day, micros, version, row): ``version`` orders the rows of an id."""
    names = [f"`{f.name}`" for f in layout.schema]
    return rows.select(
        F.col(f"`{layout.id}`").cast("long").alias("id"),
        micros(rows, layout.time).alias("micros"),
        F.struct(micros(rows, layout.arrival).alias("arrival"), F.xxhash64(*names).alias("hash")).alias("version"),
        F.struct(*names).alias("row"),
    ).withColumn("day", F.expr(f"coalesce((micros - pmod(micros, {DAY}L)) div {DAY}L, -1L)"))


def latest(rows: DataFrame, layout: Layout) -> DataFrame:
    """The keyed row of each id that arrived last; rows of one id are compared before they are shuffled."""
    whole = F.struct("version", "micros", "day", "row")
    return keyed(rows, layout).groupBy("id").agg(F.max(whole).alias("x")).select("id", "x.*")


def stored(spark: SparkSession, layout: Layout) -> DataFrame:
    """The files' rows, with the folders' numbers."""
    day, file = layout.folders()
    schema = T.StructType([*layout.schema.fields, T.StructField(day, T.LongType()), T.StructField(file, T.LongType())])
    return spark.read.schema(schema).parquet(layout.path)


def placed(met: DataFrame, layout: Layout) -> DataFrame:
    """The rows that stay, merged slice by slice: (day, file, micros, id, row).

    ``met``: (kind, day, micros, id, row), the stored rows, outgoing ids and incoming rows of whole days.
    """
    met = met.withColumn("slice", F.coalesce(F.floor(F.pmod("micros", F.lit(DAY)) / SLICE), F.lit(-1)).cast("int"))
    narrow = met.select("kind", "day", "slice", "micros", "id")
    counts = materialize(narrow.groupBy("day", "slice").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    limit = max(layout.rows_per_file, -(-total // SHARE))
    large = counts.where(F.col("count") > limit)  # at most SHARE of them
    steps = F.least(F.lit(SHARE), F.ceil(F.col("count") / limit)).cast("int")

    def quantiles(column: str, *keys: str) -> DataFrame:
        """A part's quantiles, one for each ``limit`` of its rows; together no more than 2 * SHARE."""
        every = F.percentile_approx(column, [i / SHARE for i in range(1, SHARE)], 10 * SHARE)
        found = narrow_large.groupBy(*keys).agg(every.alias("q"), F.count("*").alias("count")).where(F.col("count") > limit)
        some = F.transform(F.sequence(F.lit(1), steps - 1), lambda i: F.col("q")[(i * SHARE / steps - 1).cast("int")])
        return found.select(*keys, F.array_distinct(some).alias(f"{column}_cuts"))

    narrow_large = narrow.join(F.broadcast(large.select("day", "slice")), ["day", "slice"])
    times = materialize(quantiles("micros", "day", "slice"))
    narrow_large = timed(narrow_large, times)
    ids = materialize(quantiles("id", "day", "slice", "at"))

    def parted(df: DataFrame) -> DataFrame:
        below = F.filter("id_cuts", lambda c: c < F.col("id"))
        return timed(df, times).join(F.broadcast(ids), ["day", "slice", "at"], "left").withColumn("part", F.coalesce(F.size(below), F.lit(0))).drop("id_cuts")

    change = F.when(F.col("kind") == OUTGOING, -1).otherwise(1)
    sums = parted(narrow).groupBy(*GROUP).agg(F.sum(change).alias("n"))
    before = Window.partitionBy("day").orderBy("slice", "at", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(*GROUP, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    order = Window.partitionBy(*GROUP).orderBy("micros", "id", "kind")
    here, behind = F.struct("micros", "id"), F.lead(F.struct("kind", "micros", "id")).over(order)
    gone = F.coalesce((behind["kind"] == OUTGOING) & F.struct(behind["micros"].alias("micros"), behind["id"].alias("id")).eqNullSafe(here), F.lit(False))
    merged = parted(met).withColumn("stays", (F.col("kind") == INCOMING) | ((F.col("kind") == STORED) & ~gone))
    merged = merged.withColumn("place", F.sum(F.col("stays").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    merged = merged.where("stays").join(first, GROUP)
    file = F.floor((F.col("first") + F.col("place")) / layout.rows_per_file).cast("long")
    return merged.select("day", file.alias("file"), "micros", "id", "row")


def timed(df: DataFrame, times: DataFrame) -> DataFrame:
    """``at``: even between two cuts of the slice's times, odd at a cut, so that one time stands alone."""
    at = 2 * F.size(F.filter("micros_cuts", lambda c: c < F.col("micros"))) + F.array_contains("micros_cuts", F.col("micros")).cast("int")
    return df.join(F.broadcast(times), ["day", "slice"], "left").withColumn("at", F.coalesce(at, F.lit(0))).drop("micros_cuts")


def write_files(rows: DataFrame, layout: Layout, mode: str) -> None:
    """Each (day, file) by one task, in order; a task that is run again leaves nothing behind."""
    day, file = layout.folders()
    rows = rows.select(F.col("day").alias(day), F.col("file").alias(file), "micros", "id", "row")
    rows = rows.repartition(day, file).sortWithinPartitions(day, file, "micros", "id")
    writer = rows.select("row.*", day, file).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(day, file).parquet(layout.path)


def create(rows: DataFrame, layout: Layout) -> None:
    """Write the layout of ``rows`` into a new folder."""
    incoming = materialize(latest(rows, layout))
    write_files(placed(incoming.select(F.lit(INCOMING).alias("kind"), "day", "micros", "id", "row"), layout), layout, "errorifexists")


def overwrite_late(spark: SparkSession, late: DataFrame, layout: Layout) -> list[int]:
    """Make the folder the layout of its rows and the late ones; returns the days written anew, in order."""
    day, _ = layout.folders()
    standing = stored(spark, layout)
    now = keyed(standing.withColumn(day, F.lit(0)), layout).select(F.col("id").alias("old_id"), F.struct("version", "day", "micros").alias("old"))
    incoming = latest(late, layout)
    incoming = incoming.join(now, F.col("id").eqNullSafe(F.col("old_id")), "left")
    incoming = materialize(incoming.where(F.col("old").isNull() | (F.col("version") > F.col("old.version"))).drop("old_id", "version"))
    outgoing = incoming.where("old is not null")
    days = sorted(r[0] for r in incoming.select("day").union(outgoing.select("old.day")).distinct().collect())

    rows = standing.where(F.col(day).isin(days))  # only their folders are read
    met = keyed(rows, layout).select(F.lit(STORED).alias("kind"), "day", "micros", "id", "row")
    met = met.unionByName(outgoing.select(F.lit(OUTGOING).alias("kind"), "old.day", "old.micros", "id"), allowMissingColumns=True)
    met = met.unionByName(incoming.select(F.lit(INCOMING).alias("kind"), "day", "micros", "id", "row"))
    left = met.groupBy("day").agg(F.sum(F.when(F.col("kind") == OUTGOING, -1).otherwise(1)).alias("n"))
    left = {r["day"]: r["n"] for r in left.collect()}
    write_files(placed(met, layout), layout, "overwrite")
    remove_past_end(spark, layout, {d: -(-left.get(d, 0) // layout.rows_per_file) for d in days})
    return days


def remove_past_end(spark: SparkSession, layout: Layout, files: dict[int, int]) -> None:
    """Remove the folders of files that a day no longer has."""
    day, _ = layout.folders()
    context = spark.sparkContext
    make = context._jvm.org.apache.hadoop.fs.Path
    store = make(layout.path).getFileSystem(context._jsc.hadoopConfiguration())
    for d, n in files.items():
        at = make(f"{layout.path}/{day}={d}")
        if store.exists(at):
            for entry in store.listStatus(at):
                if int(entry.getPath().getName().rpartition("=")[2]) >= n:
                    store.delete(entry.getPath(), True)
            if n == 0:
                store.delete(at, True)


def file_report(spark: SparkSession, layout: Layout, sums: dict[str, Column]) -> DataFrame:
    """A row for each file, read in its own order: (day, file_no, n_rows, sums..., path, columns, ids_sha256).

    ``sums``: whole numbers of the layout's columns, added up over the file. The digest is taken row by row.
    """
    day, file = layout.folders()
    rows = stored(spark, layout).select(
        F.concat(F.lit(layout.path), F.regexp_extract("_metadata.file_path", f"/{day}=[^/]+/{file}=[^/]+/[^/]+$", 0)).alias("path"),
        F.col("_metadata.row_index").alias("i"),
        F.col(day).alias("day"),
        F.col(file).alias("file_no"),
        F.coalesce(F.col(f"`{layout.id}`").cast("string"), F.lit("")).alias("id"),
        *(c.cast("long").alias(f"s{k}") for k, c in enumerate(sums.values())),
    )
    rows = rows.repartition("path").sortWithinPartitions("path", "i")
    names = [f"s{k}" for k in range(len(sums))]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, totals = None, None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([v]) for v in at[:3]), *(pa.array([v], pa.int64()) for v in totals), pa.array([state.hexdigest()])],
                ["path", "day", "file_no", "n_rows", *names, "ids_sha256"],
            )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            while table.num_rows:
                key = tuple(table.column(c)[0].as_py() for c in ("path", "day", "file_no"))
                n = pa.compute.index(pa.compute.not_equal(table.column("path"), key[0]), True).as_py()
                n = table.num_rows if n < 0 else n
                head, table = table.slice(0, n), table.slice(n)
                if key != at:
                    if at:
                        yield done()
                    at, state, totals = key, hashlib.sha256(), [0] * (1 + len(names))
                state.update(("," * (totals[0] > 0) + ",".join(head.column("id").to_pylist())).encode())
                totals = [totals[0] + n, *(t + (pa.compute.sum(head.column(c)).as_py() or 0) for t, c in zip(totals[1:], names, strict=True))]
        if at:
            yield done()

    schema = "path string, day long, file_no long, n_rows long, " + "".join(f"{c} long, " for c in names) + "ids_sha256 string"
    found = rows.mapInArrow(digest, schema).withColumnsRenamed(dict(zip(names, sums, strict=True)))
    return found.withColumn("columns", F.lit(",".join(f.name for f in layout.schema)))
