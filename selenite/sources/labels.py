"""Labels of planetary images: statements of nested objects and groups, and the scans for what a rover's header tells.

A label is a text of statements ``KEYWORD = value``. Values are words, quoted texts and lists, over several lines where
quotes or brackets are open, with units in angle brackets; ``OBJECT`` and ``GROUP`` nest. Everything is
worked out from the text's columns, so labels are read wherever their files' texts come from.

A scan looks for its markers one behind the other, as they stand in the text, and then for numbers
``= (a, b, c)``; one marker that is missing gives null. Markers are found wherever they stand, also behind a start of
themselves.

Defined results: null and empty labels have no statements and null scans; ``NULL``, ``N/A`` and ``UNK`` are null values; of
repeated keywords of an object all are listed, and the first counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers of the scans.
CAMERA, AXES = "GEOMETRIC_CAMERA_MODEL", {c: f"MODEL_COMPONENT_{i}" for i, c in enumerate("cahvor", 1)}
SITE, AZIMUTH, ELEVATION = "SITE_DERIVED_GEOMETRY_PARMS", "SOLAR_AZIMUTH", "SOLAR_ELEVATION"
SOLAR_TIME, CLOCK, EYE, COUNTER = "LOCAL_TRUE_SOLAR_TIME", "SPACECRAFT_CLOCK_START_COUNT", "FRAME_ID", "ROVER_MOTION_COUNTER"
ROVER, OFFSET, ROTATION = "COORDINATE SYSTEM STATE: ROVER", "ORIGIN_OFFSET_VECTOR", "ORIGIN_ROTATION_QUATERNION"
RADIANCE, SCALE, BIAS = "DERIVED_IMAGE_PARMS", "RADIANCE_SCALING_FACTOR", "RADIANCE_OFFSET"
EYES = {"L": 1, "R": 2}

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
UNIT = r"(?:\s*<[^>]*>)?"
VALUE = r"\"[^\"]*\"|'[^']*'|\((?:[^()\"]|\"[^\"]*\"|\((?:[^()\"]|\"[^\"]*\")*\))*\)|\{(?:[^{}\"]|\"[^\"]*\")*\}|[^\r\n]*?"
STATEMENT = rf"(?m)^[ \t]*(\^?[A-Za-z][A-Za-z0-9_:]*)[ \t]*(?:=\s*({VALUE}){UNIT}[ \t]*)?(?=\r|\n|\z)"
NOTHING = ("NULL", "N/A", "UNK")


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)/\*.*?\*/", "")


def statements(labels: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, n, within, keyword, value): a row for each statement in order; ``within`` names the objects and groups around, outermost first.

    Lines that open or close one are no rows; what follows ``END`` is not read.
    """
    body = F.regexp_replace(without_comments(F.col(text)), r"(?ms)^\s*END\s*$.*", "")
    found = F.arrays_zip(F.regexp_extract_all(body, F.lit(STATEMENT), F.lit(1)).alias("k"), F.regexp_extract_all(body, F.lit(STATEMENT), F.lit(2)).alias("v"))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<within:string,keyword:string,value:string>>").alias("out"))

    def step(s: Column, one: Column) -> Column:
        key = F.upper(one["k"])
        opens, closes = key.isin("OBJECT", "GROUP"), key.isin("END_OBJECT", "END_GROUP")
        stack = F.when(opens, F.array_append(s["stack"], F.trim(one["v"]))).when(closes, F.slice(s["stack"], F.lit(1), F.greatest(F.lit(0), F.size(s["stack"]) - 1)))
        row = F.struct(F.array_join(s["stack"], "/").alias("within"), one["k"].alias("keyword"), F.trim(one["v"]).alias("value"))
        return F.struct(stack.otherwise(s["stack"]).alias("stack"), F.when(opens | closes, s["out"]).otherwise(F.array_append(s["out"], row)).alias("out"))

    every = F.aggregate(F.transform(found, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))), start, step)["out"]
    rows = labels.select(*keys, F.posexplode(every).alias("n", "s"))
    return rows.select(*keys, "n", "s.within", "s.keyword", "s.value")


def plain(value: Column) -> Column:
    """A value without quotes and units, null for the words that mean nothing."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(value, r"\s*<[^>]*>\s*$", ""), r"^[\"']|[\"']$", ""))
    return F.when(~bare.isin(*NOTHING, ""), bare)


def listed(value: Column) -> Column:
    """The entries of a list, without quotes and units; of a single value that one."""
    inside = F.regexp_replace(F.trim(value), r"^[({]\s*|\s*[)}]$", "")
    return F.transform(F.split(inside, r"\s*,\s*(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", -1), plain)


def behind(text: Column, *markers: str) -> Column:
    """The text behind the markers, each searched for behind the one before; empty if one is missing."""
    return F.regexp_extract(text, "(?s)" + ".*?".join(map(re.escape, markers)) + "(.*)", 1)


def numbers(text: Column, n: int) -> Column:
    """The first ``n`` numbers of ``= (a, b, ...``; null if they are not there."""
    inside = F.split(F.regexp_extract(text, r"^\s*=\s*\(([^)]*)", 1), ",")
    each = F.transform(F.slice(inside, 1, n), lambda v: F.nullif(F.regexp_extract(v, rf"^\s*({NUMBER}){UNIT}\s*$", 1), F.lit("")).try_cast("double"))
    return F.when((F.size(each) == n) & ~F.exists(each, lambda x: x.isNull()), each)


def number(text: Column) -> Column:
    """The number of ``= a``, in quotes or not."""
    return F.nullif(F.regexp_extract(text, rf"^\s*=\s*[\"']?\s*({NUMBER})", 1), F.lit("")).try_cast("double")


def camera_axes(text: Column) -> dict[str, Column]:
    """c, a, h, v (null if any is missing) and o, r of the camera model, and whether the last two are there."""
    marks = [CAMERA, *AXES.values()]
    out = {c: numbers(behind(text, *marks[: i + 2]), 3) for i, c in enumerate(AXES)}
    whole = out["c"].isNotNull() & out["a"].isNotNull() & out["h"].isNotNull() & out["v"].isNotNull()
    found = {c: F.when(whole, v) for c, v in out.items()}
    return found | {"got_or": F.when(whole, out["o"].isNotNull() & out["r"].isNotNull())}


def site_geometry(text: Column) -> dict[str, Column]:
    """Azimuth and elevation of the sun, and the local true solar time in seconds."""
    clock = lambda i: F.nullif(F.regexp_extract(behind(text, SOLAR_TIME), r"^\s*=\s*[\"']?(\d+):(\d+):(\d+(?:\.\d+)?)", i), F.lit("")).cast("double")
    return {"azimuth": number(behind(text, SITE, AZIMUTH)), "elevation": number(behind(text, SITE, AZIMUTH, ELEVATION)), "solar_seconds": clock(1) * 3600 + clock(2) * 60 + clock(3)}


def frame_identity(text: Column) -> dict[str, Column]:
    """The clock's start count, the eye (1 left, 2 right, 0 neither) and the last index of the motion counter."""
    letter = F.regexp_extract(behind(text, EYE), r"^\s*=\s*[\"']?([A-Za-z])", 1)
    eye = F.when(letter == "L", EYES["L"]).when(letter == "R", EYES["R"]).when(letter != "", 0)
    return {"clock": number(behind(text, CLOCK)), "eye": eye, "mast": F.element_at(numbers(behind(text, COUNTER), 4), 4).cast("int")}


def rover_origin(text: Column) -> dict[str, Column]:
    """Offset and rotation of the rover's coordinates."""
    return {"offset": numbers(behind(text, ROVER, OFFSET), 3), "rotation": numbers(behind(text, ROVER, ROTATION), 4)}


def object_value(text: Column, kind: str, name: str, keyword: str) -> Column:
    """The first value of a keyword in an ``OBJECT`` or ``GROUP`` of this name."""
    body = F.regexp_extract(without_comments(text), rf"(?ms)^\s*{kind}\s*=\s*\"?{name}\"?\s*$(.*?)^\s*END_{kind}\b", 1)
    return plain(F.nullif(F.regexp_extract(body, rf"(?m)^\s*{keyword}\s*=\s*({VALUE}){UNIT}[ \t]*(?=\r|\n|\z)", 1), F.lit("")))


def image_size(text: Column) -> dict[str, Column]:
    """Rows and columns of the label's image."""
    return {n: object_value(text, "OBJECT", "IMAGE", k).try_cast("int") for n, k in (("rows", "LINES"), ("columns", "LINE_SAMPLES"))}


def radiance(text: Column) -> dict[str, Column]:
    """Scale and offset from samples to radiance; both null unless both are numbers."""
    scale, bias = (object_value(text, "GROUP", RADIANCE, k).try_cast("double") for k in (SCALE, BIAS))
    both = scale.isNotNull() & bias.isNotNull()
    return {"scale": F.when(both, scale), "bias": F.when(both, bias)}


def keyed_number(text: Column, keyword: str) -> Column:
    """The first number of a line ``keyword = number``."""
    return F.nullif(F.regexp_extract(text, rf"(?m)^\s*{keyword}\s+=\s+({NUMBER})", 1), F.lit("")).try_cast("double")


def group_text(text: Column, name: str) -> Column:
    """What stands between ``Group = name`` and its end."""
    return F.regexp_extract(text, rf"(?ms)^\s*Group = {name}\b(.*?)^\s*End_Group", 1)


def reported_pixel(text: Column) -> dict[str, Column]:
    """Sample and line of a camera tool's report on a place; both null unless both are there."""
    x, y = keyed_number(text, "Sample"), keyed_number(text, "Line")
    both = x.isNotNull() & y.isNotNull()
    return {"sample": F.when(both, x), "line": F.when(both, y)}


def reported_range(text: Column) -> dict[str, Column]:
    """The least and largest longitude (-180 .. 180) and latitude of a report on an image; all null unless all are there."""
    lon, lat = group_text(text, "PositiveEast180"), group_text(text, "UniversalGroundRange")
    found = {f"{n}_{c}": keyed_number(t, f"{k}{w}") for c, t, w in (("lon", lon, "Longitude"), ("lat", lat, "Latitude")) for n, k in (("min", "Minimum"), ("max", "Maximum"))}
    every = None
    for v in found.values():
        every = v.isNotNull() if every is None else every & v.isNotNull()
    return {k: F.when(every, v) for k, v in found.items()}


def flat_numbers(text: Column, line: int, fields: tuple[int, int]) -> list[Column]:
    """Two fields of a line (from 0) of a comma-separated report, cut to whole numbers."""
    row = F.split(F.get(F.split(text, r"\r?\n"), F.lit(line)), ",")
    return [F.get(row, F.lit(i)).try_cast("double").cast("int") for i in fields]


def reported_size(text: Column) -> dict[str, Column]:
    """Columns and rows of an image from a report with a header line."""
    return dict(zip(("columns", "rows"), flat_numbers(text, 1, (4, 5)), strict=True))


def reported_projection(text: Column) -> dict[str, Column]:
    """The whole pixel of a place from a report without a header line."""
    return dict(zip(("x", "y"), flat_numbers(text, 0, (1, 2)), strict=True))
