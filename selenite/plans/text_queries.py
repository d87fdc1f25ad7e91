"""Queries of the text sources and the set operators, over lines rendered from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenite.plans import proxies as P
from selenite.plans.catalog import query
from selenite.functions import words
from selenite.sources import text

LINE = "concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), ',', cast(event_id % 360 as varchar), ',', cast(event_id % 90 as varchar), ',', cast(1737 + event_id % 5 as varchar), ',a,b,c,d,e,f,g,', cast(event_id % 5 + 1 as varchar))"


def csv_lines(spark, d):
    k = F.col("event_id")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(","), (k % 360).cast("string"), F.lit(","), (k % 90).cast("string"), F.lit(","),
        (1737 + k % 5).cast("string"), F.lit(",a,b,c,d,e,f,g,"), (k % 5 + 1).cast("string"),
    )
    rows = P.table(spark, d, "events").select("event_id", line.alias("line"))
    header = spark.createDataFrame([(-1, "Coordinated_Universal_Time,Pt_Longitude,Pt_Latitude,Pt_Radius")], "event_id long, line string")
    return rows.unionByName(header)


@query("select event_id, date_trunc('second', ts) as ts, cast(event_id % 360 as double) as lon, cast(event_id % 90 as double) as lat, cast(1737 + event_id % 5 as double) as rad_km, cast(event_id % 5 + 1 as integer) as s from events")
def sc01_lidar_lines(spark, d):
    return text.lidar_returns(csv_lines(spark, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("select event_id, cast(pos as integer) as token_no, token from (select event_id, unnest(string_split(event_type || ' ' || cast(user_id as varchar), ' ')) as token, unnest([0, 1]) as pos from events)")
def sc04_tokens(spark, d):
    rows = P.table(spark, d, "events").select(F.col("event_id").alias("path"), F.lit(0).alias("line_no"), F.concat("event_type", F.lit("  "), F.col("user_id").cast("string")).alias("line"))
    return text.tokens(rows).select(F.col("path").alias("event_id"), "token_no", "token")


@query("select ord, part, name from (select s_suppkey as ord, 0 as part, s_name as name from supplier where s_suppkey % 3 <> 0 union all select s_suppkey, i, 'file_' || s_suppkey || '_' || i from supplier, (select cast(unnest(range(0, 3)) as integer) as i) where s_suppkey % 3 = 0)")
def sc06_expand_inputs(spark, d):
    k = F.col("s_suppkey")
    rows = P.table(spark, d, "supplier")
    names = rows.select(k.alias("ord"), F.when(k % 3 == 0, F.concat(F.lit("list_"), k.cast("string"), F.lit(".txt"))).otherwise(F.col("s_name")).alias("name"))
    lists = rows.where(k % 3 == 0).select(
        F.concat(F.lit("list_"), k.cast("string"), F.lit(".txt")).alias("path"), F.lit(0).alias("line_no"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("file_"), k.cast("string"), F.lit("_"), i.cast("string"))), " ").alias("line"),
    )
    return text.expand_inputs(names, text.tokens(lists))


@query("select event_id, cast(event_id % 480 as integer) as row, cast(event_id % 640 as integer) as col, cast(event_id % 7 as double) as x, cast(event_id % 11 as double) as y, cast(event_id % 13 as double) as z from events where event_id % 13 > 0")
def sc16_f16_frame_points(spark, d):
    k = F.col("event_id")
    line = F.concat_ws(" ", *((k % n).cast("string") for n in (480, 640, 7, 11, 13)))
    rows = P.table(spark, d, "events").select(k.alias("path"), line.alias("line"))
    return text.frame_points(rows).where("z > 0").withColumnRenamed("path", "event_id")


@query("select s_suppkey as id, s_name as \"left\", 'n' || s_nationkey as \"right\" from supplier where s_suppkey % 4 <> 0")
def sc18_pair_list(spark, d):
    k = F.col("s_suppkey")
    line = F.when(k % 4 == 0, F.lit("# passed over")).otherwise(F.concat(F.col("s_name"), F.lit("   n"), F.col("s_nationkey").cast("string")))
    rows = P.table(spark, d, "supplier").select(k.alias("path"), F.lit(0).alias("line_no"), line.alias("line"))
    return text.pair_list(rows).select(F.col("path").alias("id"), "left", "right")


@query("select s_suppkey as id, cast(i as integer) as i, case when i < 6 then s_suppkey * 0.5 + i when i = 8 then 1.0 else 0.0 end::double as v from supplier, range(0, 9) t(i)")
def sc20_transform_list(spark, d):
    k = F.col("s_suppkey")
    line = F.concat_ws(" ", *((k * 0.5 + i).cast("double").cast("string") for i in range(6)))
    rows = P.table(spark, d, "supplier").select(k.alias("path"), F.lit(0).alias("line_no"), line.alias("line"))
    return text.transform_list(rows).select(F.col("path").alias("id"), F.posexplode("m").alias("i", "v"))


@query("select s_suppkey as id, cast(512 + s_suppkey as varchar) as lines, 'CAM_' || s_nationkey as camera, cast(s_suppkey as double) as c0, 0.5::double as c1, cast(null as varchar) as missing from supplier")
def sc14_sc15_label_headers(spark, d):
    k = F.col("s_suppkey")
    label = F.concat(
        F.lit("PDS_VERSION_ID = PDS3\n  LINES = "), (512 + k).cast("string"), F.lit("\nINSTRUMENT_ID = \"CAM_"), F.col("s_nationkey").cast("string"),
        F.lit("\"\nMODEL_COMPONENT_1 = ("), k.cast("string"), F.lit(", 0.5 <m>)\nEND\n"),
    )
    rows = P.table(spark, d, "supplier").select(k.alias("id"), label.alias("t"))
    c = text.header_vector(F.col("t"), "MODEL_COMPONENT_1")
    return rows.select(
        "id", text.header_value(F.col("t"), "LINES").alias("lines"), text.header_value(F.col("t"), "INSTRUMENT_ID").alias("camera"),
        c[0].alias("c0"), c[1].alias("c1"), text.header_value(F.col("t"), "NO_SUCH").alias("missing"),
    )


@query("select s_suppkey as id, 2 as n_parts, '.tif' as ext, 'a/b/f' || s_suppkey as stem, 'f' || s_suppkey || '.tif' as base from supplier")
def p26_string_helpers(spark, d):
    name = F.concat(F.lit("a/b/f"), F.col("s_suppkey").cast("string"), F.lit(".tif"))
    return P.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.size(text.split_dropping_tail(name, "/")).alias("n_parts"), text.file_extension(name).alias("ext"),
        text.without_extension(name).alias("stem"), text.without_path(name).alias("base"),
    )


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as t from events")
def p27_time_text(spark, d):
    return P.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))


@query("select l_orderkey as lon, l_partkey as lat, l_quantity as rad, l_discount as err from lineitem where l_discount > 0.05")
def sk02_error_table(spark, d):
    rows = P.table(spark, d, "lineitem").where("l_discount > 0.05")
    return text.error_table(rows.select(F.col("l_orderkey").alias("lon"), F.col("l_partkey").alias("lat"), F.col("l_quantity").alias("rad"), F.col("l_discount").alias("err")))


@query("select user_id as k, event_id as id from events union all select o_custkey, o_orderkey from orders")
def u01_u02_u03_concatenate(spark, d):
    a = P.table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"))
    b = P.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    return a.unionByName(b)


@query("select s_suppkey as id, n_name as name from supplier join nation on s_nationkey = n_nationkey")
def u04_index_lookup(spark, d):
    return P.table(spark, d, "supplier").join(P.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("name"))


@query(
    """select o_orderkey as id, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || 'AB' as four,
    substr(h, 3, 2) || substr(h, 1, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 15, 2) || substr(h, 13, 2) || 'AB' as two
    from (select o_orderkey, printf('%016X', o_orderkey * 1000003) as h from orders)"""
)
def p30_byte_swap(spark, d):
    raw = F.unhex(F.concat(F.lpad(F.hex(F.col("o_orderkey") * 1000003), 16, "0"), F.lit("AB")))
    return P.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.hex(words.swapped(raw, 4)).alias("four"), F.hex(words.swapped(raw, 2)).alias("two"))


@query(
    """select s_suppkey as id, cast(i as integer) as line_no, case i when 0 then 'minError= ' || cast(s_suppkey / 4.0::double as varchar) when 1 then 'maxError= ' || cast(s_suppkey + 0.5::double as varchar)
    when 2 then 'avgError= 3.5' when 3 then 'numValidPts= ' || s_suppkey when 4 then 'hist_0= ' || s_suppkey else 'hist_1= ' || (s_suppkey % 5) end as value from supplier, range(0, 6) t(i)"""
)
def sk03_statistics_lines(spark, d):
    k = F.col("s_suppkey")
    stats = P.table(spark, d, "supplier").select(
        k.alias("id"), (k / 4.0).alias("min_err"), (k + F.lit(0.5)).alias("max_err"), F.lit(3.5).alias("avg_err"), k.cast("long").alias("n"), F.array(k, k % 5).cast("array<long>").alias("hist")
    )
    return text.statistics_lines(stats, ["id"])


@query(
    """select s_suppkey as id, cast(case when i < 4 then i else 4 end as integer) as line_no, substr('CAHVR', cast(i as integer) + 1, 1) || ' = (' || printf('%.6f', (s_suppkey + i)::double) || ', ' || printf('%.6f', s_nationkey / 8.0::double)
    || ', -0.500000)' as value from supplier, range(0, 5) t(i) where i < 4 or s_nationkey % 2 = 0"""
)
def sk17_camera_lines(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    axis = lambda i: F.array((k + i).cast("double"), n / F.lit(8.0), F.lit(-0.5))
    rows = P.table(spark, d, "supplier").select(k.alias("id"), *(axis(i).alias(c) for i, c in enumerate("CAHV")), F.when(n % 2 == 0, axis(4)).alias("R"))
    return text.camera_lines(rows, ["id"])
