"""Text sources and sinks, as DataFrames with explicit schemas.

Every reader takes paths that Spark can read; nothing is opened on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, line_no, line), numbered from 0 in each file. A file is one row until it is cut up."""
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def split_fields(line: Column) -> Column:
    """Comma-separated fields, with empty ones collapsed."""
    return F.filter(F.split(line, ","), lambda x: x != "")


def lidar_returns(rows: DataFrame) -> DataFrame:
    """Returns from lines: time, longitude, latitude, radius (km) and detector (field 11). Lines without a time are headers."""
    f = split_fields(F.col("line"))
    ts = F.try_to_timestamp(F.get(f, F.lit(0)), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSS][.SSS]"))
    number = lambda i, t: F.get(f, F.lit(i)).try_cast(t)
    out = rows.select(
        *(c for c in rows.columns if c != "line"), ts.alias("ts"), number(1, "double").alias("lon"), number(2, "double").alias("lat"),
        number(3, "double").alias("rad_km"), number(11, "int").alias("s"),
    )
    return out.where("ts is not null")


def read_lidar(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Returns of several files; ``file_no`` is the place of the file in the list."""
    order = F.create_map(*(x for i, p in enumerate(paths) for x in (F.lit(p.rsplit("/", 1)[-1]), F.lit(i))))
    rows = lines(spark, list(paths)).withColumn("file_no", order[F.element_at(F.split("path", "/"), -1)])
    return lidar_returns(rows)


def tokens(rows: DataFrame, kind: str = "string") -> DataFrame:
    """White-space separated tokens in order, cast to ``kind``."""
    parts = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    return rows.select("path", "line_no", F.posexplode(parts).alias("token_no", "token")).withColumn("token", F.col("token").try_cast(kind))


def expand_inputs(names: DataFrame, listed: DataFrame) -> DataFrame:
    """Names in order, each list (.txt) replaced in place by its tokens (path, token_no, token); not recursive."""
    inner = listed.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_no", "token_no", "token"))).alias("t"))
    rows = names.join(inner, names["name"] == inner["path"], "left")
    is_list = F.col("name").endswith(".txt")
    parts = F.when(is_list, F.transform(F.col("t"), lambda x: x["token"])).otherwise(F.array("name"))
    return rows.select("ord", F.posexplode(parts).alias("part", "name")).orderBy("ord", "part")


def statistics_pairs(rows: DataFrame) -> DataFrame:
    """Statistics written as ``name= value``: four scalars and the bins."""
    pair = F.split("line", "= ")
    named = rows.where(F.size(pair) == 2).select("path", "line_no", pair[0].alias("k"), pair[1].try_cast("double").alias("v"))
    scalar = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    bins = F.sort_array(F.collect_list(F.when(F.col("k").startswith("hist"), F.struct("line_no", "v"))))
    return named.groupBy("path").agg(
        scalar("minError").alias("min_err"), scalar("maxError").alias("max_err"), scalar("avgError").alias("avg_err"),
        scalar("numValidPts").cast("long").alias("n"), F.transform(bins, lambda b: b["v"].cast("long")).alias("hist"),
    )


def statistics_lines(stats: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, line_no, value): the scalars, then the bins; without keys only the values."""
    head = [F.format_string(f"{k}= %s", F.col(c).cast("string")) for k, c in (("minError", "min_err"), ("maxError", "max_err"), ("avgError", "avg_err"), ("numValidPts", "n"))]
    bins = F.transform("hist", lambda v, i: F.format_string("hist_%d= %d", i, v))
    lines = stats.select(*keys, F.posexplode(F.concat(F.array(*head), bins)).alias("line_no", "value"))
    return lines if keys else lines.select("value")


def camera_lines(cameras: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, value): ``NAME = (a, b, c)`` for the vectors C, A, H, V, O, R (columns; null ones give no line)."""
    names = [c for c in "CAHVOR" if c in cameras.columns]
    line = lambda c: F.concat(F.lit(f"{c} = ("), F.array_join(F.transform(F.col(c), lambda v: F.format_string("%.6f", v.cast("double"))), ", "), F.lit(")"))
    return cameras.select(*keys, F.posexplode(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), line(c)) for c in names)))).alias("line_no", "value"))


def frame_points(rows: DataFrame) -> DataFrame:
    """A frame's cloud from ``row col x y z`` lines."""
    parts = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    p = rows.select("path", parts.alias("p")).where(F.size("p") >= 5)
    return p.select("path", F.col("p")[0].cast("int").alias("row"), F.col("p")[1].cast("int").alias("col"), *(F.col("p")[i + 2].cast("double").alias(c) for i, c in enumerate("xyz")))


def pair_list(rows: DataFrame) -> DataFrame:
    """Two names a line; blank lines and comments are passed over."""
    kept = rows.where(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    p = F.split(F.trim("line"), r"\s+")
    return kept.select("path", "line_no", p[0].alias("left"), p[1].alias("right"))


def transform_list(rows: DataFrame) -> DataFrame:
    """Six numbers a line as a 3 x 3 matrix, row-major."""
    p = F.transform(F.filter(F.split("line", r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    ends = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return rows.where(F.size(p) == 6).select("path", "line_no", F.concat(p, ends).alias("m"))


def header_value(text: Column, keyword: str) -> Column:
    """The value of ``KEYWORD = value`` in a label, without quotes and units; null if absent."""
    return F.nullif(F.regexp_extract(text, rf"(?m)^\s*{keyword}\s*=\s*\"?([^\"\r\n<]*?)\"?\s*(?:<[^>]*>)?\s*$", 1), F.lit(""))


def header_vector(text: Column, keyword: str) -> Column:
    """The numbers of ``KEYWORD = (a, b, c)``."""
    inside = F.regexp_extract(text, rf"(?m)^\s*{keyword}\s*=\s*\(([^)]*)\)", 1)
    return F.transform(F.split(inside, r"\s*,\s*"), lambda x: F.regexp_replace(x, r"<[^>]*>", "").try_cast("double"))


def split_dropping_tail(text: Column, mark: str) -> Column:
    """Parts before each mark; what follows the last one is dropped."""
    parts = F.split(text, F.lit(mark))
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def file_extension(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def without_path(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def write_lines(rows: DataFrame, path: str, column: str = "value") -> None:
    """One element a line. Raises on an empty input, as a file without lines would be mistaken for a finished one."""
    if rows.isEmpty():
        raise ValueError("nothing to write")
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def error_table(errors: DataFrame) -> DataFrame:
    """Longitude, latitude, radius and error, in that order."""
    return errors.select("lon", "lat", "rad", "err")


def write_error_table(errors: DataFrame, path: str) -> None:
    error_table(errors).write.mode("overwrite").csv(path, header=True)
