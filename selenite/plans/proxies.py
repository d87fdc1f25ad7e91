"""The domain's tables, modelled on the driver's: in Spark and, alike, as SQL.

``SQL`` holds the common table expressions; ``with_views`` puts the named ones
before a statement. Rasters hold every vector.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SQL = {
    "v_return": """select o.o_custkey as track_id, l.l_orderkey as shot_id, l.l_linenumber as s, l.l_quantity as x, l.l_discount as y,
        l.l_extendedprice as z, o.o_orderdate as ts, row_number() over (partition by l.l_orderkey
        order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) as pt_idx
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey""",
    "v_shot": """select track_id, shot_id, row_number() over (partition by track_id order by ts, shot_id) - 1 as shot_idx,
        case when shot_id % 7 = 0 then -1.0 else z / 100000 end as refl, case when shot_id % 11 = 0 then -1.0 else x / 50 end as image,
        x, y, z, n_pts from (select track_id, shot_id, min(ts) as ts, min_by(x, pt_idx) as x, min_by(y, pt_idx) as y,
        min_by(z, pt_idx) as z, count(*) as n_pts from v_return group by track_id, shot_id)""",
    "v_event": """select user_id, event_id, ts, cast(event_id % 5 + 1 as integer) as s, value from events""",
    "v_raster": """select cast(i - 1 as integer) as x, cast(vec_id as integer) as y, cast(embedding[i] as double) as v
        from embeddings, range(1, 65) t(i)""",
    "v_pix": """select event_id, (event_id * 37 % 6300) / 100.0 as px, (event_id * 91 % (select greatest(1, max(vec_id) * 100) from embeddings)) / 100.0 as py,
        value from events""",
}
_NEEDS = {"v_shot": ["v_return"]}


def with_views(statement: str, *names: str) -> str:
    ordered: list[str] = []
    for n in names:
        ordered += [*_NEEDS.get(n, []), n]
    return "with " + ", ".join(f"{n} as materialized ({SQL[n]})" for n in dict.fromkeys(ordered)) + " " + statement


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a part that one task sorts and groups.
PART_ROWS = 1 << 17


def parts(rows: DataFrame) -> int:
    """Into how many parts a table of that length is dealt, so that a task's memory does not grow with the table."""
    return rows.count() // PART_ROWS + 1


def returns(spark: SparkSession, d: str) -> DataFrame:
    """Laser returns: a track for each customer, a shot for each order, a return for each line."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    n = parts(lines)
    lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select(
        F.col("o_custkey").alias("track_id"), F.col("l_orderkey").alias("shot_id"), F.col("l_linenumber").alias("s"),
        F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("z"),
        F.col("o_orderdate").alias("ts"), F.row_number().over(order).alias("pt_idx"),
    )


def shots(spark: SparkSession, d: str) -> DataFrame:
    """One row a shot, ordered in its track, with sentinels of -1 for missing values."""
    first = [F.min_by(c, "pt_idx").alias(c) for c in ("x", "y", "z")]
    rows = returns(spark, d).groupBy("track_id", "shot_id").agg(F.min("ts").alias("ts"), *first, F.count("*").alias("n_pts"))
    rows = rows.repartition(parts(table(spark, d, "orders")), "track_id")
    order = W.partitionBy("track_id").orderBy("ts", "shot_id")
    return rows.select(
        "track_id", "shot_id", (F.row_number().over(order) - 1).alias("shot_idx"),
        F.when(F.col("shot_id") % 7 == 0, F.lit(-1.0)).otherwise(F.col("z") / 100000).alias("refl"),
        F.when(F.col("shot_id") % 11 == 0, F.lit(-1.0)).otherwise(F.col("x") / 50).alias("image"), "x", "y", "z", "n_pts",
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.select("user_id", "event_id", "ts", (F.col("event_id") % 5 + 1).cast("int").alias("s"), "value")


def height(spark: SparkSession, d: str) -> int:
    """Rows of the raster: one more than the last vector's number."""
    last = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0]
    return 0 if last is None else int(last) + 1


def raster(spark: SparkSession, d: str) -> DataFrame:
    """64 columns, a row for each vector."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return rows.select("x", F.col("vec_id").cast("int").alias("y"), F.col("v").cast("double").alias("v"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Points with fractional pixel coordinates, all over the raster."""
    rows, span = table(spark, d, "events"), max(1, (height(spark, d) - 1) * 100)
    return rows.select("event_id", (F.col("event_id") * 37 % 6300 / 100.0).alias("px"), (F.col("event_id") * 91 % span / 100.0).alias("py"), "value")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show."""
    return df.select(*(F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names; a local session without any gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="selenite-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/selenite-{uuid.uuid4().hex}"
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path
