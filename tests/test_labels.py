"""Labels by hand."""

from pyspark.sql import functions as F

from selenite.sources import labels

LABEL = '''PDS_VERSION_ID = PDS3 /* the
version = 9 */
^IMAGE = 12
ROVER_MOTION_COUNTER = (1, 2, 3,
   14, 5)
FRAME_ID = "RIGHT"
SPACECRAFT_CLOCK_START_COUNT = "128287181.273"
LOCAL_TRUE_SOLAR_TIME = "13:05:07.5"
NOTE = "a = b
  GROUP = NONE"
OBJECT = IMAGE
  LINES = 1024
  LINE_SAMPLES = 512 <pixel>
  GROUP = BANDS
    NAMES = ("RED, NEAR", 'BLUE', NULL)
    WIDTH = (1.5 <nm>, 2 <nm>)
  END_GROUP = BANDS
  UNIT = N/A
END_OBJECT = IMAGE
GROUP = GEOMETRIC_CAMERA_MODEL_PARMS
  MODEL_COMPONENT_1 = (1.0, -2.5e0, .5)
  MODEL_COMPONENT_2 = (0,1,0)
  MODEL_COMPONENT_3 = ( 7 , 8 , 9 )
  MODEL_COMPONENT_4 = (4 <m>,5 <m>,6 <m>)
END_GROUP = GEOMETRIC_CAMERA_MODEL_PARMS
/* COORDINATE SYSTEM STATE: ROVER */
ORIGIN_OFFSET_VECTOR = (1.25,2,3)
ORIGIN_ROTATION_QUATERNION = (1,0,0,0.5)
GROUP = SITE_DERIVED_GEOMETRY_PARMS
  SOLAR_AZIMUTH = 12.5 <deg>
  SOLAR_ELEVATION = -3
END_GROUP
GROUP = DERIVED_IMAGE_PARMS
  RADIANCE_OFFSET = 0.125
  RADIANCE_SCALING_FACTOR = 2.0e-3 <x>
END_GROUP
END
AFTER = 1
'''


def test_statements_of_nested_objects(spark):
    df = spark.createDataFrame([(1, LABEL.replace("\n", "\r\n")), (2, LABEL), (3, None), (4, "")], "id int, t string")
    rows = [(r.id, r.within, r.keyword, r.value) for r in labels.statements(df, "t", ["id"]).orderBy("id", "n").collect()]
    got = {(w, k): v for i, w, k, v in rows if i == 2}
    assert {r[0] for r in rows} == {1, 2} and sum(r[0] == 1 for r in rows) == len(got)
    assert got["", "PDS_VERSION_ID"] == "PDS3" and got["", "^IMAGE"] == "12" and got["", "NOTE"] == '"a = b\n  GROUP = NONE"'
    assert got["IMAGE", "LINES"] == "1024" and got["IMAGE", "LINE_SAMPLES"] == "512" and got["IMAGE/BANDS", "WIDTH"] == "(1.5 <nm>, 2 <nm>)"
    assert got["DERIVED_IMAGE_PARMS", "RADIANCE_SCALING_FACTOR"] == "2.0e-3" and ("", "AFTER") not in got
    lists = labels.statements(df.where("id = 2"), "t", ["id"]).where("within = 'IMAGE/BANDS'").select("keyword", labels.listed(F.col("value")).alias("v")).collect()
    assert {r.keyword: r.v for r in lists} == {"NAMES": ["RED, NEAR", "BLUE", None], "WIDTH": ["1.5", "2"]}


def test_scans(spark):
    text = F.col("t")
    every = labels.camera_axes(text) | labels.site_geometry(text) | labels.frame_identity(text) | labels.rover_origin(text) | labels.image_size(text) | labels.radiance(text)
    more = LABEL.replace("MODEL_COMPONENT_4 = (4 <m>,5 <m>,6 <m>)", "MODEL_COMPONENT_4 = (4,5,6)\n MODEL_COMPONENT_5 = (1,2,3)\n MODEL_COMPONENT_6 = (3,2,1)").replace("RIGHT", "LEFT").replace("0.125", '"NULL"')
    cases = [LABEL, more, None, "", LABEL.replace("MODEL_COMPONENT_3", "MODEL_COMPONENT_X"), "FRAME_IDFRAME_FRAME_ID = \"MONO\""]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, t string").select("id", *(c.alias(n) for n, c in every.items()))
    got = {r.id: r.asDict() for r in df.collect()}
    first = got[0]
    assert (first["c"], first["a"], first["h"], first["v"]) == ([1.0, -2.5, 0.5], [0.0, 1.0, 0.0], [7.0, 8.0, 9.0], [4.0, 5.0, 6.0])
    assert (first["o"], first["r"], first["got_or"]) == (None, None, False)
    assert (first["azimuth"], first["elevation"], first["solar_seconds"]) == (12.5, -3.0, 47107.5)
    assert (first["clock"], first["eye"], first["mast"]) == (128287181.273, 2, 14)
    assert (first["offset"], first["rotation"]) == ([1.25, 2.0, 3.0], [1.0, 0.0, 0.0, 0.5])
    assert (first["rows"], first["columns"], first["scale"], first["bias"]) == (1024, 512, 0.002, 0.125)
    assert (got[1]["o"], got[1]["r"], got[1]["got_or"], got[1]["eye"]) == ([1.0, 2.0, 3.0], [3.0, 2.0, 1.0], True, 1)
    assert got[1]["scale"] is None and got[1]["bias"] is None and got[4]["c"] is None and got[4]["got_or"] is None
    assert all(v is None for k in (2, 3) for n, v in got[k].items() if n != "id") and got[5]["eye"] is None


def test_reports_without_their_numbers(spark):
    df = spark.createDataFrame([(None,), ("",), ("Sample = 3\n",), ("Group = PositiveEast180\nMinimumLongitude = 1\nEnd_Group",), ("a,b\n1",)], "t string")
    t = F.col("t")
    found = labels.reported_pixel(t) | labels.reported_range(t) | labels.reported_size(t) | labels.reported_projection(t)
    assert all(v is None for r in df.select(*(c.alias(n) for n, c in found.items())).collect() for v in r)
